"""Forests of deep regression trees: large nodes are split by sums over all tasks, small ones are grown where their rows meet."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.session import removed, settled, settled_at

#: Bins of a feature, as Spark ML has them by default.
BINS = 32
#: Rows of a node that one task grows to its leaves; larger nodes are split by sums of all tasks.
PIECE_ROWS = 1 << 17
#: Training rows in a record, rows times trees that are dealt out at once, rows of a table whose predictions one task sums.
BLOCK_ROWS, WAVE_ROWS, PREDICTED_ROWS = 1 << 14, 1 << 26, 1 << 20
#: Bytes that a task gets, about.
TASK_BYTES = 16 << 20
#: Values of the bootstrap: how often a row is drawn has a Poisson distribution of mean 1.
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def drawn(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in the bootstrap sample of a tree: fixed by the row's id, wherever the row lies."""
    own = _mix(np.array([seed * 1_000_003 + tree], dtype=np.int64).view(np.uint64) * _ODD)
    return np.searchsorted(_DRAWN, (_mix(ids ^ own) >> np.uint64(11)).astype(np.float64) / 2.0**53, "right")


def _picked(nodes: np.ndarray, features: int, chosen: int) -> np.ndarray:
    """The features that each node looks at, by its own hash."""
    lots = _mix(nodes[:, None] * np.uint64(64) + np.arange(features, dtype=np.uint64) + np.uint64(1))
    return np.sort(np.argsort(lots, axis=1)[:, :chosen], axis=1)


def _name(seed: int, tree: int, low: bytes, high: bytes) -> np.uint64:
    """A hash of a node by the box of bins that it holds."""
    out = np.array([seed, tree], dtype=np.int64).view(np.uint64)
    for v in np.frombuffer(low + high, dtype=np.uint8).astype(np.uint64):
        out = _mix(out * _ODD + v)
    return _mix(out[:1] * _ODD + out[1:])[0]


def _best(node: np.ndarray, bins: np.ndarray, w: np.ndarray, centred: np.ndarray, start: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes that a feature can split, the gain of the best split and the last bin on its left.

    Rows of a node stand together, and its centred values sum to zero.
    """
    keys = np.sort((node << 8 | bins) << 32 | np.arange(len(node)))
    pos, cell = keys & 0xFFFFFFFF, keys >> 32
    at = np.flatnonzero((cell[1:] != cell[:-1]) & (cell[1:] >> 8 == cell[:-1] >> 8))
    nodes = cell[at] >> 8
    if not len(at):
        return nodes, np.zeros(0), nodes
    sums, weights = np.append(0.0, np.cumsum((w * centred)[pos])), np.append(0.0, np.cumsum(w[pos]))
    s, left = sums[at + 1] - sums[start[nodes]], weights[at + 1] - weights[start[nodes]]
    gain = s * s * (1 / left + 1 / (total[nodes] - left))
    first = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
    most = np.maximum.reduceat(gain, first)
    hits = np.flatnonzero(gain == np.repeat(most, np.diff(first, append=len(at))))
    hits = hits[np.append(True, nodes[hits[1:]] != nodes[hits[:-1]])]  # of equal gains the lowest bin
    return nodes[first], most, cell[at[hits]] & 255


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, name: np.uint64, chosen: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree over rows x (features x rows, bins), drawn w times each: nodes, their values, and the gains by feature.

    A node is one number: its left child (the right one follows), feature and last bin on the left; a leaf is negative.
    All nodes of a level are split together. A node stays a leaf when its values are equal, no feature that it looks
    at gains anything, or at the depth limit.
    """
    features = len(x)
    gains = np.zeros(features)
    nodes, values, made = [], [], 0
    row, start = np.arange(len(y)), np.zeros(1, dtype=np.int64)
    for level in range(depth + 1):
        m = len(start)
        node = np.repeat(np.arange(m), np.diff(start, append=len(row)))
        own, weight = y[row], w[row].astype(np.float64)
        total = np.add.reduceat(weight, start)
        mean = np.add.reduceat(weight * own, start) / total
        values.append(mean)
        split = (np.maximum.reduceat(own, start) > np.minimum.reduceat(own, start)) & (level < depth)
        best, feature, cut = np.zeros(m), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        if split.any():
            inside = split[node]
            row, number = row[inside], np.cumsum(split) - 1  # from here on nodes that may be split have numbers of their own
            ids = np.flatnonzero(split)
            node, weight = number[node[inside]], weight[inside]
            centred = own[inside] - mean[ids][node]
            first, total = np.searchsorted(node, np.arange(len(ids))), total[ids]
            square = np.add.reduceat(weight * centred * centred, first)
            looked = _picked(_mix(name + (ids + made).astype(np.uint64) * _ODD), features, chosen)
            for k in range(chosen):
                at, gain, last = _best(node, x[looked[node, k], row].astype(np.int64), weight, centred, first, total)
                better = gain > np.maximum(best[ids[at]], 1e-12 * square[at])
                at, to = at[better], ids[at[better]]
                best[to], feature[to], cut[to] = gain[better], looked[at, k], last[better]
        split = best > 0
        rank = np.cumsum(split) - 1
        nodes.append(np.where(split, (made + m + 2 * rank) << 16 | feature << 8 | cut, -1))
        gains += np.bincount(feature[split], best[split], features)
        made += m
        if not split.any():
            break
        node = ids[node]
        inside = split[node]
        row, node = row[inside], node[inside]
        node = 2 * rank[node] + (x[feature[node], row] > cut[node])
        order = np.argsort(node, kind="stable")
        row, start = row[order], np.searchsorted(node[order], np.arange(2 * int(split.sum())))
    return np.concatenate(nodes), np.concatenate(values), gains


def predicted(nodes: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value of the leaf of each row of x (rows x features, bins)."""
    out = np.empty(len(x))
    for begin in range(0, len(x), 1 << 15):
        part = x[begin:begin + (1 << 15)]
        flat, own = part.ravel(), np.arange(len(part)) * part.shape[1]
        leaf = np.zeros(len(part), dtype=np.int64)
        at, row = leaf.copy(), np.arange(len(part))
        while True:
            code = nodes[at]
            done = code < 0
            if done.any():
                leaf[row[done]] = at[done]
                row, own, code = row[~done], own[~done], code[~done]
            if not len(row):
                break
            at = (code >> 16) + (flat[own + (code >> 8 & 255)] > (code & 255))
        out[begin:begin + len(part)] = values[leaf]
    return out


def thresholds(train: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Values that part each feature into at most BINS bins of about equally many rows, from one aggregate."""
    ranks = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    one = train.agg(*[F.percentile_approx(F.col(f).cast("double"), ranks, F.lit(10_000)).alias(f"_{k}") for k, f in enumerate(features)]).first()
    return [np.unique(np.asarray(v if v is not None else [], dtype=float)) for v in one]


def _binned(column: pa.Array, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins (rows x features) of a column of arrays; a row without a number for each feature is an error."""
    flat = column.flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64)
    if len(x) != len(column) * len(cuts) or not np.isfinite(x).all():
        raise ValueError("features must be finite numbers")
    x = x.reshape(-1, len(cuts))
    return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, bins, targets and ids of each record of training rows."""
    for block, n, x, y, ids in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "x", "y", "id")), strict=True):
        yield block, np.frombuffer(x, dtype=np.uint8).reshape(-1, n), np.frombuffer(y), np.frombuffer(ids, dtype=np.uint64)


@dataclass
class Node:
    """A node that is split by sums of all tasks, or that one task will grow: the box of its bins."""

    tree: int
    low: bytes
    high: bytes
    depth: int
    rows: int
    value: float | None = None  # of a large node that cannot be split

    def holds(self, x: np.ndarray) -> np.ndarray:
        """Which rows of x (features x rows) lie in the box."""
        out = np.ones(x.shape[1], dtype=bool)
        for own, a, b in zip(x, self.low, self.high, strict=True):
            if a > 0:
                out &= own >= a
            if b < 255:
                out &= own <= b
        return out


class Grower:
    """The trees of a forest over one table, grown in waves of as many as WAVE_ROWS allows.

    Each tree draws rows by a hash of `key`, which should be unique; each node looks at a third of the features, and
    the largest gain in squared error decides. So a forest does not depend on how rows are dealt, but for the bins,
    which are approximate ranks, and the last digits of the sums over nodes beyond PIECE_ROWS.
    """

    def __init__(self, train: DataFrame, features: Sequence[str], target: str, key: str, trees: int = 500, depth: int = 30, seed: int = 42) -> None:
        self.spark, self.features, self.trees, self.depth, self.seed = train.sparkSession, list(features), trees, depth, seed
        self.chosen = -(-len(self.features) // 3)
        rows = train.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(target).cast("double").alias("y"),
                            F.xxhash64(key).alias("id"), F.col(key).alias("_key"))
        rows, path = settled_at(rows, "train")
        self.cuts = thresholds(rows.select(*[F.get("x", F.lit(k)).alias(f) for k, f in enumerate(features)]), features)
        self.blocks, self.path = settled_at(self._blocks(rows.orderBy("_key", "id", "x", "y")), "blocks")
        removed(self.spark, path)
        self.rows = self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not self.rows:
            raise ValueError("there are no rows to grow trees from")
        self.parallel = self.spark.sparkContext.defaultParallelism

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """Training rows in records of at most BLOCK_ROWS, whose numbers follow the order of the rows."""
        cuts = self.cuts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                for begin in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(begin, BLOCK_ROWS)
                    y = np.asarray(part.column("y").to_numpy(zero_copy_only=False), dtype=np.float64)
                    if not np.isfinite(y).all():
                        raise ValueError("the target must be a finite number")
                    x = np.ascontiguousarray(_binned(part.column("x"), cuts).T)
                    ids = np.asarray(part.column("id"), dtype=np.int64)
                    yield pa.RecordBatch.from_pydict({"block": pa.array([number]), "n": pa.array([len(y)], pa.int64()), "x": [x.tobytes()], "y": [y.tobytes()], "id": [ids.tobytes()]})
                    number += 1

        return rows.mapInArrow(run, "block long, n long, x binary, y binary, id binary")

    def _sums(self, nodes: list[Node]) -> DataFrame:
        """The best split of each node: feature, last bin on the left, gain and rows of both sides; no feature, but the mean, for a leaf."""
        seed, chosen, features = self.seed, self.chosen, len(self.features)
        by_tree: dict[int, list[int]] = {}
        for k, node in enumerate(nodes):
            by_tree.setdefault(node.tree, []).append(k)
        looked = {k: _picked(np.array([_name(seed, node.tree, node.low, node.high)]), features, chosen)[0] for k, node in enumerate(nodes)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for _, x, y, ids in _read(batch):
                    for tree, own in by_tree.items():
                        w = drawn(ids, seed, tree)
                        for k in own:
                            at = np.flatnonzero(nodes[k].holds(x) & (w > 0))
                            weight, value = w[at].astype(np.float64), y[at]
                            sums = found.setdefault(k, np.zeros((chosen, 4, BINS)))
                            for j, f in enumerate(looked[k]):
                                for i, v in enumerate((weight, weight * value, weight * value * value, None)):
                                    sums[j, i] += np.bincount(x[f][at], v, BINS)
            yield pa.RecordBatch.from_pydict({"node": pa.array(list(found), pa.int64()), "sums": pa.array([v.tobytes() for v in found.values()], pa.binary())})

        def best(table: pa.Table) -> pa.Table:
            k = table.column("node")[0].as_py()
            sums = sum(np.frombuffer(v.as_py()).reshape(chosen, 4, BINS) for v in table.column("sums"))
            w, s, q, n = (sums[:, i].cumsum(axis=1) for i in range(4))
            total, mean = w[0, -1], s[0, -1] / max(w[0, -1], 1)
            left, right = w[:, :-1], total - w[:, :-1]
            inside = (left > 0) & (right > 0)
            gain = np.where(inside, (s[:, :-1] - left * mean) ** 2 * (1 / np.maximum(left, 1) + 1 / np.maximum(right, 1)), 0.0)
            j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
            use = gain[j, cut] > 1e-12 * max(q[0, -1], 1e-300)
            row = (k, int(looked[k][j]) if use else -1, int(cut), float(gain[j, cut]), int(n[j, cut]), int(n[j, -1] - n[j, cut]), float(mean))
            return pa.table([pa.array([v]) for v in row], names=["node", "feature", "cut", "gain", "first", "last", "mean"])

        return self.blocks.select("block", "n", "x", "y", "id").mapInArrow(run, "node long, sums binary").groupBy("node").applyInArrow(
            best, "node long, feature long, cut long, gain double, first long, last long, mean double")

    def _tops(self, trees: range) -> tuple[list[Node], dict[int, np.ndarray]]:
        """The nodes of at most PIECE_ROWS rows of some trees, and what the splits above them gain."""
        whole = bytes(len(self.features)), b"\xff" * len(self.features)
        open_ = [Node(t, *whole, 0, self.rows) for t in trees]
        ready: list[Node] = []
        gains = {t: np.zeros(len(self.features)) for t in trees}
        while open_:
            large = [n for n in open_ if n.rows > PIECE_ROWS and n.depth < self.depth]
            ready += [n for n in open_ if not (n.rows > PIECE_ROWS and n.depth < self.depth)]
            open_ = []
            for r in self._sums(large).collect() if large else []:  # a row for each large node
                node, f = large[r["node"]], r["feature"]
                if f < 0:
                    node.value = r["mean"]
                    ready.append(node)
                    continue
                gains[node.tree][f] += r["gain"]
                middle = bytes([r["cut"]]), bytes([r["cut"] + 1])
                open_ += [Node(node.tree, node.low, node.high[:f] + middle[0] + node.high[f + 1:], node.depth + 1, r["first"]),
                          Node(node.tree, node.low[:f] + middle[1] + node.low[f + 1:], node.high, node.depth + 1, r["last"])]
        return sorted(ready, key=lambda n: (n.tree, n.low, n.high)), gains

    def _grown(self, nodes: list[Node]) -> DataFrame:
        """Rows (tree, piece, low, high, nodes, leaf values, gains): what is below each node."""
        seed, chosen, depth, features = self.seed, self.chosen, self.depth, len(self.features)
        pieces = [n for n in nodes if n.value is None]
        by_tree: dict[int, list[int]] = {}
        for k, node in enumerate(pieces):
            by_tree.setdefault(node.tree, []).append(k)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, x, y, ids in _read(batch):
                    for tree, own in by_tree.items():
                        w = drawn(ids, seed, tree)
                        for k in own:
                            at = np.flatnonzero(pieces[k].holds(x) & (w > 0))
                            if len(at):
                                yield pa.RecordBatch.from_pydict({
                                    "piece": pa.array([k], pa.int64()), "block": pa.array([block], pa.int64()), "x": [x[:, at].tobytes()],
                                    "y": [y[at].tobytes()], "w": [w[at].astype(np.uint8).tobytes()]})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def made() -> pa.RecordBatch:
                k = held[0][0]
                node = pieces[k]
                w = np.concatenate([np.frombuffer(h[3], dtype=np.uint8) for h in held])
                x = np.concatenate([np.frombuffer(h[1], dtype=np.uint8).reshape(features, -1) for h in held], axis=1)
                y = np.concatenate([np.frombuffer(h[2]) for h in held])
                codes, values, gains = grow(x, y, w, depth - node.depth, _name(seed, node.tree, node.low, node.high), chosen)
                return pa.RecordBatch.from_pydict({
                    "tree": pa.array([node.tree], pa.int64()), "piece": pa.array([k], pa.int64()), "low": [node.low], "high": [node.high],
                    "nodes": [codes.tobytes()], "leaves": [values[codes < 0].tobytes()], "gains": pa.array([gains.tolist()], pa.list_(pa.float64()))})

            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("piece", "x", "y", "w")), strict=True):
                    if held and held[0][0] != row[0]:
                        yield made()
                        held.clear()
                    held.append(row)
            if held:
                yield made()

        drawn_bytes = sum(n.rows for n in pieces) * (features + 9)
        parts = max(4 * self.parallel, drawn_bytes // TASK_BYTES + 1)
        return self.blocks.mapInArrow(deal, "piece long, block long, x binary, y binary, w binary").repartition(parts, "piece").sortWithinPartitions(
            "piece", "block").mapInArrow(run, "tree long, piece long, low binary, high binary, nodes binary, leaves binary, gains array<double>")

    def waves(self) -> Iterator[tuple[range, list[Node], dict[int, np.ndarray], DataFrame]]:
        size = max(1, min(self.trees, WAVE_ROWS // self.rows))
        for begin in range(0, self.trees, size):
            trees = range(begin, min(begin + size, self.trees))
            nodes, gains = self._tops(trees)
            yield trees, nodes, gains, self._grown(nodes)

    def importances(self) -> DataFrame:
        """Share of each feature in the gains of a tree, the mean over the trees, largest first."""
        total = np.zeros(len(self.features))
        for _, _, gains, grown in self.waves():
            sums = grown.groupBy("tree").agg(*[F.sum(F.get("gains", F.lit(k))) for k in range(len(self.features))])
            for tree, *own in sums.collect():  # a row for each tree
                gains[tree] += own
            total += sum(g / g.sum() for g in gains.values() if g.sum() > 0)
        removed(self.spark, self.path)
        share = (total / total.sum() if total.sum() > 0 else total).tolist()
        rows = sorted(zip(self.features, share, strict=True), key=lambda r: (-r[1], r[0]))
        return self.spark.createDataFrame(rows, "feature string, importance double")

    def predictions(self, rows: DataFrame, x: str = "x") -> DataFrame:
        """Rows, but for the array of features `x`, with the mean `prediction` of all trees.

        Rows stand in blocks; a task has some of the trees and some of the blocks and returns a sum for each block.
        """
        names = [c for c in rows.columns if c != x]
        blocks = settled(self._asked(rows, x, names), "asked")
        asked = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        parts = -(-max(asked, 1) // PREDICTED_ROWS)
        sums = []
        for trees, nodes, _, grown in self.waves():
            grown, path = settled_at(grown.select("tree", "piece", "low", "high", "nodes", "leaves"), "trees")
            sums.append(settled(self._summed(blocks, grown, [n for n in nodes if n.value is not None], len(trees), parts), "sums"))
            removed(self.spark, path)
        removed(self.spark, self.path)
        total = sums[0]
        for s in sums[1:]:
            total = total.union(s)
        total = total.groupBy("block").applyInArrow(_added, "block long, data binary")
        trees, schema = self.trees, rows.select(*names).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    out = {c: batch.column(c)[k].values for c in names}
                    yield pa.RecordBatch.from_pydict(out | {"prediction": pa.array(np.frombuffer(batch.column("data")[k].as_py()) / trees)})

        return blocks.join(total, "block").select(*names, "data").mapInArrow(run, schema.add("prediction", "double"))

    def _asked(self, rows: DataFrame, x: str, names: list[str]) -> DataFrame:
        cuts = self.cuts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = {c: pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in names}
                yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "n": pa.array([batch.num_rows], pa.int64()),
                                                  "bins": [_binned(batch.column(x), cuts).tobytes()]} | lists)
                number += 1

        lists = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in rows.select(*names).schema)
        return rows.select(x, *names).mapInArrow(run, f"block long, n long, bins binary, {lists}")

    def _summed(self, blocks: DataFrame, grown: DataFrame, single: list[Node], trees: int, parts: int) -> DataFrame:
        """Sum over some trees of the predictions of each block: (block, data)."""
        features = len(self.features)
        groups = max(-(-2 * self.parallel // parts), self.rows * trees * 16 // TASK_BYTES + 1)
        groups = min(groups, trees)
        none = F.lit(None).cast("binary")
        deal = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        copies = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")
        asked = blocks.select(part.alias("part"), F.lit(0).alias("kind"), F.col("block").alias("at"), F.col("bins").alias("data"), none.alias("leaves"),
                              none.alias("low"), none.alias("high"), deal.alias("g"))
        told = grown.select(copies.alias("part"), F.lit(1).alias("kind"), F.col("piece").alias("at"), F.col("nodes").alias("data"), "leaves", "low", "high",
                            F.pmod("tree", F.lit(groups)).cast("int").alias("g"))
        dealt = asked.unionByName(told).repartition(groups * parts, "g", "part").sortWithinPartitions("g", "part", "kind", "at")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, int]] = []  # block and rows
            bins: list[np.ndarray] = []
            now, x, sums = None, np.zeros((0, features), dtype=np.uint8), np.zeros(0)

            def done() -> Iterator[pa.RecordBatch]:
                begin = 0
                for block, n in held:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "data": [sums[begin:begin + n].tobytes()]})
                    begin += n

            for batch in batches:
                for k in range(batch.num_rows):
                    g, part, kind, at = (batch.column(c)[k].as_py() for c in ("g", "part", "kind", "at"))
                    data = batch.column("data")[k].as_buffer()
                    if now != (g, part):
                        if len(sums):
                            yield from done()
                        held, bins, now, sums = [], [], (g, part), np.zeros(0)
                    if kind == 0:
                        bins.append(np.frombuffer(data, dtype=np.uint8).reshape(-1, features).copy())
                        held.append((at, len(bins[-1])))
                        continue
                    if not held:
                        continue
                    if not len(sums):
                        x = np.concatenate(bins)
                        bins, sums = [], np.zeros(len(x))
                    codes = np.frombuffer(data, dtype=np.int64)
                    values = np.zeros(len(codes))
                    values[codes < 0] = np.frombuffer(batch.column("leaves")[k].as_buffer())
                    low, high = (np.frombuffer(batch.column(c)[k].as_buffer(), dtype=np.uint8) for c in ("low", "high"))
                    if not low.any() and (high == 255).all():
                        sums += predicted(codes, values, x)
                        continue
                    inside = np.flatnonzero((x >= low).all(axis=1) & (x <= high).all(axis=1))
                    sums[inside] += predicted(codes, values, x[inside])
            if len(sums):
                yield from done()

        out = dealt.mapInArrow(run, "block long, data binary")
        if single:
            out = out.union(blocks.select("block", "bins").mapInArrow(_large_leaves(single, features), "block long, data binary"))
        return out.groupBy("block").applyInArrow(_added, "block long, data binary")


def _added(table: pa.Table) -> pa.Table:
    """Rows of one block, added up."""
    total = np.sum([np.frombuffer(v.as_buffer()) for v in table.column("data")], axis=0)
    return pa.table({"block": table.column("block")[:1], "data": pa.array([total.tobytes()], pa.binary())})


def _large_leaves(nodes: list[Node], features: int):
    """Values of large nodes that no feature splits, for the rows in their boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, bins in zip(*(batch.column(c).to_pylist() for c in ("block", "bins")), strict=True):
                x = np.frombuffer(bins, dtype=np.uint8).reshape(-1, features).T
                out = np.zeros(x.shape[1])
                for node in nodes:
                    out[node.holds(x)] += node.value
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "data": [out.tobytes()]})

    return run


def forest_importances(train: DataFrame, features: Sequence[str], target: str, key: str = "sample", trees: int = 500, depth: int = 30,
                       seed: int = 42) -> DataFrame:
    """Feature importances of a forest, largest first."""
    return Grower(train, features, target, key, trees, depth, seed).importances()


def forest_predictions(train: DataFrame, rows: DataFrame, features: Sequence[str], target: str, key: str = "sample", trees: int = 500,
                       depth: int = 30, seed: int = 42, x: str = "x") -> DataFrame:
    """Rows with the `prediction` of a forest for their array of features `x`, which is left out."""
    return Grower(train, features, target, key, trees, depth, seed).predictions(rows, x)
