"""Co-training of a text-content and a page-metadata classifier for document quality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import ALNUM, SPACE, Words, free_name, mix, pieces

#: Rows used for fitting, at most: labelled ones and further ones without a label. Everything is scored.
LABELLED, UNLABELLED = 8_000, 4_000
#: Buckets of hashed features, rounds of exchange, share of the unlabelled rows that a view passes on in a round.
BUCKETS, ROUNDS, PASSED_ON, CONFIDENT = 1 << 18, 4, 0.05, 0.95
TARGETS = ("quality", "toxic")
_SIGNS = ~(SPACE | ALNUM)
_LAYOUT = ("length", "word", "lines", "signs", "digits", "capitals", "again")


def _first_per_text(text: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs."""
    both = np.unique(text << 32 | bucket)
    return both >> 32, both & 0xFFFFFFFF


def text_features(column: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs of words and runs of signs; only of the chosen buckets if there is a choice."""
    text, bucket = [], []
    for kind, seed in ((ALNUM, 0), (_SIGNS, 1)):
        words = Words(column, kind)
        own = (mix(words.hashes + np.uint64(seed)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        at = np.flatnonzero(chosen[own]) if chosen is not None else np.arange(len(own))
        bucket.append(own[at])
        text.append(np.searchsorted(words.docs, at, "right") - 1)
    return _first_per_text(np.concatenate(text), np.concatenate(bucket))


def page_features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs of source, language, recorded length and the layout of the page, in steps."""
    words = Words(batch.column("text"))
    n = batch.num_rows
    total = np.diff(words.offsets).astype(np.float64)

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / np.maximum(of, 1)

    count = np.diff(words.docs).astype(np.float64)
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], words.hashes[1:] == words.hashes[:-1]])[:len(words.hashes)])])
    recorded = np.asarray(batch.column("length").fill_null(0), dtype=np.float64)
    raw = words.raw
    layout = {"length": np.log2(1 + np.maximum(recorded, 0)) * 2, "word": total / np.maximum(count, 1),
              "lines": np.log2(1 + total * share(raw == 10, total)), "signs": 40 * np.sqrt(share(_SIGNS[raw] & ~((raw >= 65) & (raw <= 90)), total)),
              "digits": 20 * np.sqrt(share((raw >= 48) & (raw <= 57), total)),
              "capitals": 20 * np.sqrt(share((raw >= 65) & (raw <= 90), total)),
              "again": 20 * np.sqrt((same[words.docs[1:]] - same[words.docs[:-1]]) / np.maximum(count, 1))}
    row, value = [], []
    for k, name in enumerate(_LAYOUT):
        step = np.minimum(layout[name], 1000).astype(np.int64)
        row.append(np.arange(n))
        value.append(mix(np.uint64(k + 1) * np.uint64(4096) + step.astype(np.uint64)))
    for name in ("source", "lang"):
        own = np.asarray(batch.column(name + "_hash"), dtype=np.int64).view(np.uint64)
        row.append(np.arange(n))
        value.append(mix(own))
    bucket = (np.concatenate(value) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return _first_per_text(np.concatenate(row), bucket)


@dataclass
class Linear:
    """Weight of each bucket and the constant of a logistic model."""

    weights: np.ndarray
    constant: float

    def score(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.weights[bucket], n) + self.constant


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, weight: np.ndarray, features: int = 2048,
               least: float = 15.0, penalty: float = 2.0, steps: int = 200) -> Linear:
    """Logistic regression on the buckets that tell the classes apart (chi square of presence, `least` or more)."""
    n = len(y)
    some = weight > 0
    if not some.all():
        used = some[row]
        row, bucket = row[used], bucket[used]
    one, zero = float((weight * y).sum()), float((weight * (1 - y)).sum())
    a = np.bincount(bucket, (weight * y)[row], BUCKETS)
    b = np.bincount(bucket, (weight * (1 - y))[row], BUCKETS)
    total = one + zero
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = total * (a * (zero - b) - b * (one - a)) ** 2 / ((a + b) * (total - a - b) * one * zero)
    chi = np.nan_to_num(chi, nan=0.0, posinf=0.0)
    chosen = np.argsort(-chi, kind="stable")[:features]
    chosen = chosen[(chi[chosen] >= least) & ((a + b)[chosen] >= 5)]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    seen = place[bucket] >= 0
    row, column = row[seen], place[bucket[seen]]
    w, c = np.zeros(len(chosen)), float(np.log((one + 1) / (zero + 1)))
    m_w, v_w, m_c, v_c = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):  # full-batch Adam
        z = np.bincount(row, w[column], n) + c
        error = (_sigmoid(z) - y) * weight / max(total, 1)
        g = np.bincount(column, error[row], len(w)) + penalty * w / max(total, 1)
        g_c = float(error.sum())
        m_w, v_w = 0.9 * m_w + 0.1 * g, 0.99 * v_w + 0.01 * g * g
        m_c, v_c = 0.9 * m_c + 0.1 * g_c, 0.99 * v_c + 0.01 * g_c * g_c
        rate = 0.1 * (1 - t / (steps + 1)) + 0.005
        w = w - rate * (m_w / (1 - 0.9 ** t)) / (np.sqrt(v_w / (1 - 0.99 ** t)) + 1e-9)
        c = c - rate * (m_c / (1 - 0.9 ** t)) / (np.sqrt(v_c / (1 - 0.99 ** t)) + 1e-9)
    weights = np.zeros(BUCKETS)
    weights[chosen] = w
    return Linear(weights, c)


def _platt(scores: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a small logistic regression on columns of scores, the constant last; Newton steps."""
    x = np.column_stack([scores, np.ones(len(y))])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ beta)
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (p - y) + ridge * beta)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Views:
    """Two fitted views of one target, their calibrations and the combination of both."""

    text: Linear
    page: Linear
    text_scale: np.ndarray
    page_scale: np.ndarray
    both: np.ndarray

    def probabilities(self, z_text: np.ndarray, z_page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = z_text * self.text_scale[0] + self.text_scale[1]
        b = z_page * self.page_scale[0] + self.page_scale[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(a * self.both[0] + b * self.both[1] + self.both[2])


def co_train(text: tuple[np.ndarray, np.ndarray], page: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray,
             rounds: int = ROUNDS) -> Views | None:
    """Fits both views. y is NaN where there is no label; rows of fold 0 calibrate and are not fitted on.

    In each round a view labels the rows without label that it is surest of, and the other view learns from them.
    None if the labels do not hold both classes.
    """
    known = ~np.isnan(y)
    fit, held, pool = known & (fold > 0), known & (fold == 0), np.flatnonzero(~known)
    if not (0 < y[fit].sum() < fit.sum()) or not (0 < y[held].sum() < held.sum()):
        return None
    own = {"text": np.where(known, y, 0.0), "page": np.where(known, y, 0.0)}
    weight = {k: fit.astype(np.float64) for k in own}
    views = {"text": text, "page": page}
    models: dict[str, Linear] = {}
    share = float(y[fit].mean())
    for turn in range(rounds + 1):
        for k, (row, bucket) in views.items():
            models[k] = fit_linear(row, bucket, own[k], weight[k])
        if turn == rounds or not len(pool):
            break
        for k, other in (("text", "page"), ("page", "text")):
            z = models[k].score(*views[k], len(y))
            a, b = _platt(z[held][:, None], y[held])
            p = _sigmoid(a * z[pool] + b)
            free = weight[other][pool] == 0
            for label, sure, part in ((1.0, p, share), (0.0, 1 - p, 1 - share)):
                most = int(PASSED_ON * len(pool) * part) + 1
                best = np.argsort(-np.where(free, sure, -1), kind="stable")[:most]
                rows = pool[best[(sure[best] >= CONFIDENT) & free[best]]]
                own[other][rows], weight[other][rows] = label, 0.5
    z_text, z_page = (models[k].score(*views[k], len(y)) for k in ("text", "page"))
    t, p = _platt(z_text[held][:, None], y[held]), _platt(z_page[held][:, None], y[held])
    both = _platt(np.column_stack([z_text[held] * t[0] + t[1], z_page[held] * p[0] + p[1]]), y[held])
    return Views(models["text"], models["page"], t, p, both)


def _column(docs: DataFrame, name: str) -> Column:
    return F.xxhash64(F.col(name).cast("string")) if name in docs.columns else F.lit(0).cast("long")


def _inputs(docs: DataFrame) -> list[Column]:
    """What the views see: text, recorded length and hashes of source and language."""
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")
    return [F.col("text").cast("string").alias("text"), length.alias("length"),
            _column(docs, "source").alias("source_hash"), _column(docs, "lang").alias("lang_hash")]


def _sample(docs: DataFrame, labels: DataFrame, labelled: int, unlabelled: int) -> pa.Table:
    """Features of a bounded sample on the driver: the rows whose hashed doc_id is smallest."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.round(F.avg("quality")).alias("quality"), F.round(F.avg("toxic")).alias("toxic"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    rank = F.xxhash64(F.lit(7), "_id")
    with_label = ids.join(known, "_id").orderBy(rank, "_id").limit(labelled)
    without = ids.join(known, "_id", "left_anti").orderBy(rank, "_id").limit(unlabelled)
    chosen = with_label.unionByName(without, allowMissingColumns=True).toArrow()  # at most labelled + unlabelled rows
    small = docs.sparkSession.createDataFrame(chosen, "_id long, quality double, toxic double")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), *_inputs(docs)).join(F.broadcast(small), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            parts = []
            for row, bucket in (text_features(batch.column("text")), page_features(batch)):
                at = np.searchsorted(row, np.arange(batch.num_rows + 1))
                parts.append(pa.array([bucket[a:b].astype(np.uint32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("quality"), batch.column("toxic"), *parts],
                                             ["doc_id", "quality", "toxic", "of_text", "of_page"])

    rows = rows.mapInArrow(run, "doc_id long, quality double, toxic double, of_text binary, of_page binary")
    return rows.toArrow().sort_by("doc_id")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED,
          rounds: int = ROUNDS) -> dict[str, Views | None]:
    """Views for each target, fitted on a bounded sample of the documents."""
    table = _sample(docs, labels, labelled, unlabelled)
    ids = np.asarray(table.column("doc_id"), dtype=np.int64)
    first = np.concatenate([[True], ids[1:] != ids[:-1]])[:len(ids)] if len(ids) else np.zeros(0, dtype=bool)
    table = table.filter(pa.array(first))
    ids = ids[first]
    fold = (mix(ids.view(np.uint64)) % np.uint64(4)).astype(np.int64)
    views = []
    for name in ("of_text", "of_page"):
        parts = [np.frombuffer(x, dtype=np.uint32) for x in table.column(name).to_pylist()]
        views.append((np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts]),
                      np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, dtype=np.int32)))
    out = {}
    for target in TARGETS:
        y = table.column(target).to_pandas().to_numpy(dtype=np.float64, na_value=np.nan) if len(ids) else np.zeros(0)
        out[target] = co_train(views[0], views[1], y, fold, rounds)
    return out


def _scores(batch: pa.RecordBatch, models: dict[str, Views | None], chosen: np.ndarray) -> dict[str, tuple[np.ndarray, ...]]:
    n = batch.num_rows
    of_text, of_page = text_features(batch.column("text"), chosen), page_features(batch)
    out = {}
    for target in TARGETS:
        m = models[target]
        if m is None:  # nothing to learn from: good until shown otherwise
            out[target] = (np.full(n, 1.0 if target == "quality" else 0.0),) * 3
        else:
            out[target] = m.probabilities(m.text.score(*of_text, n), m.page.score(*of_page, n))
    return out


def _chosen(models: dict[str, Views | None]) -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=bool)
    for m in models.values():
        if m is not None:
            out |= m.text.weights != 0
    return out


def _accepted(scores: dict[str, tuple[np.ndarray, ...]]) -> np.ndarray:
    return (scores["quality"][2] >= 0.5) & (scores["toxic"][2] < 0.5)


def score_documents(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """Scores of every document: doc_id, text_score, page_score, score, toxic_score and accepted.

    The first three are calibrated probabilities of good quality from the text, from the page's metadata and from
    both; toxic_score is that of toxic content from both. A document is accepted when score is at least 0.5 and
    toxic_score below it. Null text counts as empty, null source and language as values of their own; repeated rows get
    the same scores; conflicting labels of one document are averaged and rounded. Without labels of both classes every
    document is accepted. An empty table gives no rows; other columns are ignored.
    """
    models = train(docs, labels, **options)
    chosen = _chosen(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            s = _scores(batch, models, chosen)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, s["quality"]), pa.array(s["toxic"][2]), pa.array(_accepted(s))],
                ["doc_id", "text_score", "page_score", "score", "toxic_score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs))
    return rows.mapInArrow(run, "doc_id long, text_score double, page_score double, score double, toxic_score double, accepted boolean")


def keep_accepted(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """The accepted documents, with all their columns."""
    models = train(docs, labels, **options)
    chosen = _chosen(models)
    names = docs.columns
    inside = F.struct(*_inputs(docs)).alias(free_name("_seen", names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = pa.RecordBatch.from_struct_array(batch.column(len(names)))
            start = 0
            for part in pieces(iter([seen]), "text"):
                own = batch.slice(start, part.num_rows).select(names)
                start += part.num_rows
                yield own.filter(pa.array(_accepted(_scores(part, models, chosen))))

    return docs.select("*", inside).mapInArrow(run, docs.schema)
