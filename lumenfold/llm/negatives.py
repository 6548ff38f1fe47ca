"""Hard negatives by the threshold algorithm: sorted lists for each dimension, exact integer scores, early stopping."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import written

#: Rows whose lists are held at once, at most; rows of a shard while there are few; anchors searched against a shard in one group.
SHARD, SMALL_SHARD, SLICE = 1 << 17, 1 << 13, 1 << 15
#: Shares of a window's bounds in the positive's score, both in hundredths.
LOW, HIGH = 30, 90
_LIMIT = 1 << 63
Enough = Callable[[np.ndarray, np.ndarray, int], bool]


class SortedLists:
    """Integer vectors of a shard with one list of rows for each dimension, in rising order of that component.

    An anchor reads a dimension's list from the top where its own component is positive and from the bottom where it
    is negative; zero components are not read. After `t` reads of each list no unread row can score more than the
    anchor's product with the values read last: the threshold.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")  # a stable order by score then breaks ties by smaller id
        self.ids, self.labels, self.vectors = ids[by_id], labels[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32).T.copy()
        self.values = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.largest = int(max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0)))))

    def search(self, anchor: np.ndarray, enough: Enough) -> tuple[np.ndarray, np.ndarray]:
        """Rows read under sorted access and their scores, until `enough(rows, scores, threshold)` holds or all are read.

        The lists are read in rounds of doubled depth; once half of the rows are known, the others are read at once.
        """
        n = len(self.ids)
        exact = self.largest * int(np.abs(anchor).max(initial=0)) * max(len(anchor), 1)
        kind = np.float64 if exact < 1 << 53 else np.int64 if exact < _LIMIT else object
        own = anchor.astype(kind)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, dtype=bool)
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        done, t = 0, 8
        while True:
            if t >= n or 2 * len(rows) >= n:
                return np.arange(n), self._scores(self.vectors, own, kind)
            fresh = np.zeros(n, dtype=bool)
            fresh[self.order[up, n - t:n - done].ravel()] = True
            fresh[self.order[down, done:t].ravel()] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            rows = np.concatenate([rows, new])
            scores = np.concatenate([scores, self._scores(self.vectors[new], own, kind)])
            threshold = sum(int(anchor[d]) * int(self.values[d, n - t]) for d in up) + sum(int(anchor[d]) * int(self.values[d, t - 1]) for d in down)
            if enough(rows, scores, threshold):
                return rows, scores
            done, t = t, 2 * t

    @staticmethod
    def _scores(vectors: np.ndarray, anchor: np.ndarray, kind: type) -> np.ndarray:
        out = vectors.astype(kind) @ anchor
        return np.clip(out, -_LIMIT, _LIMIT - 1).astype(np.int64) if kind is object else out.astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in `rows` of the k highest scores, ties by smaller id."""
        if len(rows) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            may = np.flatnonzero(scores >= kth)
        else:
            may = np.arange(len(rows))
        return may[np.lexsort((rows[may], -scores[may]))][:k]

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best other rows of the same label."""

        def same(rows: np.ndarray) -> np.ndarray:
            return (self.labels[rows] == label) & (self.ids[rows] != anchor_id)

        def enough(rows: np.ndarray, scores: np.ndarray, threshold: int) -> bool:
            return np.count_nonzero(scores[same(rows)] > threshold) >= k

        rows, scores = self.search(anchor, enough)
        use = same(rows)
        rows, scores = rows[use], scores[use]
        at = self.best(rows, scores, k)
        return self.ids[rows[at]], scores[at]

    def negatives(self, label: int, anchor: np.ndarray, positives: list[int], k: int, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each positive's score, ids and scores of the k best rows of other labels inside its window."""

        def inside(scores: np.ndarray, p: int) -> np.ndarray:
            least, most = -(-low * p // 100), high * p // 100  # whole scores, so the bounds are rounded inwards
            return (scores >= least) & (scores <= most)

        def enough(rows: np.ndarray, scores: np.ndarray, threshold: int) -> bool:
            own = scores[self.labels[rows] != label]
            return all(100 * threshold < low * p or np.count_nonzero(inside(own, p) & (own > threshold)) >= k for p in positives if low * p <= high * p)

        if not any(low * p <= high * p for p in positives):
            none = np.zeros(0, dtype=np.int64)
            return [(none, none)] * len(positives)
        rows, scores = self.search(anchor, enough)
        use = self.labels[rows] != label
        rows, scores = rows[use], scores[use]
        out = []
        for p in positives:
            may = np.flatnonzero(inside(scores, p))
            at = may[self.best(rows[may], scores[may], k)]
            out.append((self.ids[rows[at]], scores[at]))
        return out


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists of longs as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def _lists(shard: pa.Table) -> SortedLists:
    return SortedLists(np.asarray(shard.column("vec_id")), np.asarray(shard.column("label")), _vectors(shard.column("vector")))


def _grouped(rows: DataFrame, anchors: DataFrame, shards: int, slices: int):
    """Every shard of the rows beside every slice of the anchors, as bounded groups of an equi-join."""
    deal = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    deal = deal.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    ask = anchors.withColumn("a_slice", F.pmod(F.xxhash64("a_id", F.lit(1)), F.lit(slices)).cast("int"))
    ask = ask.withColumn("a_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return deal.groupBy("size", "shard", "slice").cogroup(ask.groupBy("a_size", "a_shard", "a_slice"))


def mine(rows: DataFrame, scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 10, low: int = LOW, high: int = HIGH,
         relabel: tuple[int, int] | None = (7, 10), shard: int = SHARD, slice_: int = SLICE) -> DataFrame:
    """Hard negatives of embeddings (vec_id, embedding, label): rows of other labels that score near a positive, not at it.

    Components become floor(`scale` * x); a score is the integer inner product with the anchor. Anchors are the rows
    whose vec_id is divisible by `every`; their positives the best `positives` other rows of the label; for each
    positive the best `negatives` rows of other labels with low * positive <= 100 * score <= high * positive. With
    `relabel` (m, k) the label of rows whose vec_id is divisible by m becomes (label + 1) % k first. Returns anchor_id,
    positive_id, rank, negative_id, positive_score and negative_score; ties go to smaller ids. A positive with an empty
    window has no row.

    The rows are dealt by id into shards of about `shard` and the anchors into slices of about `slice_`; each pair of
    both is one bounded group, searched twice by the threshold algorithm: for positives, then, with the windows of the
    overall positives, for negatives. A shard's best are merged by rank, so no group depends on a label or a vector,
    however often it occurs.

    Rows with a null vec_id, label or vector, and vectors with a null or non-finite component, take no part. A vec_id
    that several rows have counts once, with the least label and vector. Vectors meet those of their own length only.
    Scores are exact; beyond 64 bits they stop at the largest long. An empty table gives no rows; other columns are
    ignored.
    """
    number = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    if relabel:
        label = F.when(F.col("vec_id") % relabel[0] == 0, (label + 1) % relabel[1]).otherwise(label)
    base = rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(
        label.alias("label"), F.transform(number, lambda x: F.floor(x * scale)).alias("vector")).alias("row"))
    base = base.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.vector")
    base = written(base.withColumn("size", F.size("vector")), "vectors")
    asked = base.where(F.col("vec_id") % every == 0).select(*[F.col(c).alias(f"a_{n}") for c, n in (
        ("vec_id", "id"), ("label", "label"), ("vector", "vector"), ("size", "size"))])
    total, n_anchors = base.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    # each shard gives an anchor's best rows once, so shards are no more than the tasks that small tables can use
    shards = max(-(-total // shard), min(64, -(-total // SMALL_SHARD)), 1)
    slices = max(-(-n_anchors // slice_), 1)

    def find_positives(held: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if held.num_rows and ask.num_rows:
            lists = _lists(held)
            for anchor, own, v in zip(ask.column("a_id").to_pylist(), ask.column("a_label").to_pylist(), _vectors(ask.column("a_vector")), strict=True):
                ids, scores = lists.positives(anchor, own, v, positives)
                out[0] += [anchor] * len(ids)
                out[1] += ids.tolist()
                out[2] += scores.tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], ["anchor_id", "positive_id", "positive_score"])

    found = _grouped(base, asked, shards, slices).applyInArrow(find_positives, "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives)
    best = written(best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("k", "positive_id", "positive_score"))).alias("positives")), "positives")
    windows = asked.join(best, F.col("a_id") == F.col("anchor_id")).select(
        *asked.columns, F.transform("positives", lambda p: p["positive_score"]).alias("a_scores"))

    def find_negatives(held: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if held.num_rows and ask.num_rows:
            lists = _lists(held)
            for anchor, own, scores, v in zip(ask.column("a_id").to_pylist(), ask.column("a_label").to_pylist(),
                                              ask.column("a_scores").to_pylist(), _vectors(ask.column("a_vector")), strict=True):
                for k, (ids, values) in enumerate(lists.negatives(own, v, scores, negatives, low, high)):
                    out[0] += [anchor] * len(ids)
                    out[1] += [k + 1] * len(ids)
                    out[2] += ids.tolist()
                    out[3] += values.tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], ["anchor_id", "k", "negative_id", "negative_score"])

    near = _grouped(base, windows, shards, slices).applyInArrow(find_negatives, "anchor_id long, k long, negative_id long, negative_score long")
    place = Window.partitionBy("anchor_id", "k").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    out = near.join(best, "anchor_id").withColumn("p", F.element_at("positives", F.col("k").cast("int")))
    return out.select("anchor_id", "p.positive_id", "rank", "negative_id", "p.positive_score", "negative_score")
