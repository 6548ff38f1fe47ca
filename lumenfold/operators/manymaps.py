"""PCA, k-means, NMF and alternating least squares of many maps at once.

Pixels are packed into matrix blocks, one binary row for each block of a map. The blocks of a map of at most
`LOCAL_BYTES` meet in one task, which makes all passes over them by itself: any number of such maps is one job. Larger
maps stay distributed: a pass is then one job for all of them together, every task adds up the products of the blocks
it holds by map, Spark adds those up, and each map has its own model and stops by itself, so ten maps take no more jobs
than the slowest of them. Both ways run the same fit over the same sums.

The driver holds one model a map, components x channels; `waves` cuts a table with so many maps that their models
would not fit.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.matrix import Factorisation, PrincipalAxes, list_of, ols_clip, upward
from lumenfold.operators.nnls import nnls_gram, nnls_rows

#: Values in a block, and values of unfinished blocks that a task holds before it gives them out.
BLOCK_VALUES, HELD_VALUES = 1 << 17, 1 << 23
#: Channels up to which second moments are gathered; more are reduced by random projections.
MAX_CHANNELS = 4096
#: Bytes of partial sums that are added up on the driver; more are added up by Spark.
DRIVER_BYTES = 16 << 20
#: Bytes of models that one wave of maps may have on the driver.
WAVE_BYTES = 32 << 20
#: Bytes of pixels up to which the passes over a map are made inside one task.
LOCAL_BYTES = 32 << 20
ALL = "{}"
Product = Callable[[np.ndarray, tuple], np.ndarray]
Change = Callable[[np.ndarray], np.ndarray]


def map_key(maps: Sequence[str]) -> Column:
    """The values of the key columns as one text; the same text for all rows when there are none."""
    return F.to_json(F.struct(*maps)) if maps else F.lit(ALL)


class Source:
    """Blocks of maps as the fits see them: `sizes` has pixels and channels of each map."""

    sizes: dict[str, tuple[int, int]]

    def sums(self, models: Mapping[str, tuple], product: Product, shape: Callable[[tuple], int]) -> dict[str, np.ndarray]:
        """For each map with a model, the sum of product(block, model) over its blocks; `shape` gives its values."""
        raise NotImplementedError

    def highest(self, models: Mapping[str, tuple], draw: Product) -> dict[str, np.ndarray]:
        """Rows of draw(block, model), score first; for each map and row number the row with the highest score."""
        raise NotImplementedError

    def factors(self, models: Mapping[str, tuple], change: Change | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """R of the QR factorisation of all projected pixels, (x - mean) q and x u, of each map with a model (mean, q, u)."""
        raise NotImplementedError

    def each(self, names: Sequence[str], fit: Callable[[Source, list[str]], dict]) -> dict:
        """fit(source, names) of all maps, wherever their blocks are."""
        raise NotImplementedError


class Local(Source):
    """All blocks of some maps in memory."""

    def __init__(self, held: dict[str, list[np.ndarray]]) -> None:
        self.held = held
        self.sizes = {m: (sum(map(len, x)), x[0].shape[1]) for m, x in held.items()}

    def sums(self, models: Mapping[str, tuple], product: Product, shape: Callable[[tuple], int]) -> dict[str, np.ndarray]:
        out = {}
        for m, model in models.items():
            for x in self.held.get(m, ()):
                out[m] = out[m] + product(x, model) if m in out else product(x, model)
        return out

    def highest(self, models: Mapping[str, tuple], draw: Product) -> dict[str, np.ndarray]:
        return {m: best_rows([draw(x, model) for x in self.held[m]]) for m, model in models.items() if self.held.get(m)}

    def factors(self, models: Mapping[str, tuple], change: Change | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for m, (mean, q, u) in models.items():
            for x in self.held.get(m, ()):
                x = x if change is None else change(x)
                new = ((x - mean) @ q, x @ u)
                out[m] = tuple(np.linalg.qr(np.vstack([r, y]) if m in out else y, "r") for r, y in zip(out.get(m, new), new))
        return out

    def each(self, names: Sequence[str], fit: Callable[[Source, list[str]], dict]) -> dict:
        return fit(self, list(names))


def best_rows(found: list[np.ndarray]) -> np.ndarray:
    best = found[0]
    for other in found[1:]:
        best = np.where(other[:, :1] > best[:, :1], other, best)
    return best


def _matrices(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[str, np.ndarray]]:
    """Map and matrix of each block (map, n, x)."""
    for key, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        if n:
            yield key, np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(n, -1)


class Blocks(Source):
    """Matrix blocks (map, n, x) of a table's spectra, kept for several passes."""

    def __init__(self, data: DataFrame, sizes: dict[str, tuple[int, int]]) -> None:
        self.data, self.sizes = data, sizes
        self.partitions = data.rdd.getNumPartitions()

    def release(self) -> None:
        self.data.unpersist()

    def _of(self, names: Sequence[str]) -> DataFrame:
        few = len(names) < len(self.sizes) and len(names) <= 100
        return self.data.where(F.col("map").isin(list(names))) if few else self.data

    def _collected(self, parts: DataFrame, models: Mapping[str, tuple], shape: Callable[[tuple], int]) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for batch in parts.toArrow().to_batches():
            width = np.diff(np.asarray(batch.column(2).offsets))
            flat, at = np.asarray(batch.column(2).flatten(), dtype=np.float64), 0
            for key, r, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), width.tolist(), strict=True):
                out.setdefault(key, np.zeros((shape(models[key]) // w, w)))[r] += flat[at:at + w]
                at += w
        return out

    def partial(self, models: Mapping[str, tuple], product: Product) -> DataFrame:
        """Rows (map, r, v) of each task's sums."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[str, np.ndarray] = {}
            for batch in batches:
                for key, x in _matrices(batch):
                    if key in models:
                        part = product(x, models[key])
                        totals[key] = totals[key] + part if key in totals else part
            for key, total in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(total)), pa.array(np.arange(len(total), dtype=np.int32)), list_of(total)], ["map", "r", "v"])

        return self._of(list(models)).mapInArrow(run, "map string, r int, v array<double>")

    def few(self, values: int) -> bool:
        """Whether the tasks' partial sums of so many values are added up on the driver."""
        return 8 * self.partitions * values <= DRIVER_BYTES

    def sums(self, models: Mapping[str, tuple], product: Product, shape: Callable[[tuple], int]) -> dict[str, np.ndarray]:
        parts = self.partial(models, product)
        return self._collected(parts if self.few(sum(map(shape, models.values()))) else _by_spark(parts), models, shape)

    def highest(self, models: Mapping[str, tuple], draw: Product) -> dict[str, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[str, np.ndarray] = {}
            for batch in batches:
                for key, x in _matrices(batch):
                    if key in models:
                        own = draw(x, models[key])
                        best[key] = best_rows([best[key], own]) if key in best else own
            for key, rows in best.items():
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows)), pa.array(np.arange(len(rows), dtype=np.int32)), list_of(rows)], ["map", "r", "v"])

        parts = self._of(list(models)).mapInArrow(run, "map string, r int, v array<double>")
        parts = parts.groupBy("map", "r").agg(F.max_by("v", F.get("v", F.lit(0))).alias("v")).orderBy("map", "r")
        out: dict[str, list] = {}
        for row in parts.collect():
            out.setdefault(row["map"], []).append(row["v"])
        return {m: np.asarray(v) for m, v in out.items()}

    def factors(self, models: Mapping[str, tuple], change: Change | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, tuple] = {}
            for batch in batches:
                for key, x in _matrices(batch):
                    if key in models:
                        own = Local({key: [x]}).factors({key: models[key]}, change)[key]
                        held[key] = tuple(np.linalg.qr(np.vstack(z), "r") for z in zip(held[key], own)) if key in held else own
            for key, rs in held.items():
                for kind, r in enumerate(rs):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([kind], pa.int32()), list_of(r.reshape(1, -1))], ["map", "kind", "v"])

        def merge(rows: pa.Table) -> pa.Table:
            width = models[rows.column("map")[0].as_py()][1].shape[1]
            r = np.linalg.qr(np.asarray(rows.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(-1, width), "r")
            return pa.table([rows.column("map")[:1], rows.column("kind")[:1], list_of(r.reshape(1, -1))], ["map", "kind", "v"])

        schema = "map string, kind int, v array<double>"
        parts = self._of(list(models)).mapInArrow(run, schema)
        if self.partitions > 64:  # a level between: groups of the tasks' factors
            parts = parts.withColumn("s", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("map", "kind", "s").applyInArrow(merge, schema)
        out: dict[str, dict[int, np.ndarray]] = {}
        for row in parts.groupBy("map", "kind").applyInArrow(merge, schema).collect():
            out.setdefault(row["map"], {})[row["kind"]] = np.asarray(row["v"]).reshape(-1, models[row["map"]][1].shape[1])
        return {m: (r[0], r[1]) for m, r in out.items()}

    def each(self, names: Sequence[str], fit: Callable[[Source, list[str]], dict]) -> dict:
        small = [m for m in names if 8 * self.sizes[m][0] * self.sizes[m][1] <= LOCAL_BYTES]
        large = [m for m in names if m not in set(small)]
        out = fit(self, large) if large else {}
        if not small:
            return out
        wanted = set(small)

        def run(rows: pa.Table) -> pa.Table:
            key = rows.column("map")[0].as_py()
            found = fit(Local({key: [x for _, x in _matrices(rows)]}), [key]) if key in wanted else {}
            return pa.table([pa.array(list(found), pa.string()), pa.array([pickle.dumps(v) for v in found.values()], pa.binary())], ["map", "model"])

        # a number that is asked for, as adaptive execution would put maps of few bytes and many passes into one task
        held = sum(8 * self.sizes[m][0] * self.sizes[m][1] for m in small)
        tasks = min(len(small), max(self.data.sparkSession.sparkContext.defaultParallelism, held // LOCAL_BYTES))
        fitted = self._of(small).repartition(tasks, "map").groupBy("map").applyInArrow(run, "map string, model binary").collect()
        return out | {r["map"]: pickle.loads(r["model"]) for r in fitted}


def pack(spectra: DataFrame, maps: Sequence[str] = (), column: str = "intensity") -> Blocks:
    """Blocks of all spectra that are not null; those of a map are equally long. One pass, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        values: dict[str, int] = {}

        def block(key: str) -> pa.RecordBatch:
            x = np.concatenate(held.pop(key))
            del values[key]
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["map", "n", "x"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode()
            names, codes, lists = keys.dictionary.to_pylist(), np.asarray(keys.indices), batch.column(1)
            for c, key in enumerate(names):
                part = lists if len(names) == 1 else lists.take(pa.array(np.flatnonzero(codes == c)))
                x = np.asarray(part.flatten(), dtype=np.float64).reshape(len(part), -1)
                held.setdefault(key, []).append(x)
                values[key] = values.get(key, 0) + x.size
                if values[key] >= BLOCK_VALUES:
                    yield block(key)
            if sum(values.values()) > HELD_VALUES:
                for key in list(held):
                    yield block(key)
        for key in list(held):
            yield block(key)

    rows = spectra.select(map_key(maps).alias("map"), F.col(column).cast("array<double>").alias("x")).where("x is not null")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a few large files would keep a few cores busy
        rows = rows.repartition(cores)
    # read by every pass; lost blocks are packed again from the source
    data = rows.mapInArrow(run, "map string, n long, x binary").persist(StorageLevel.MEMORY_AND_DISK)
    found = data.groupBy("map").agg(F.sum("n").alias("n"), F.max(F.octet_length("x") / (8 * F.col("n"))).cast("int").alias("p")).collect()
    return Blocks(data, {r["map"]: (r["n"], r["p"]) for r in found})


def _by_spark(parts: DataFrame) -> DataFrame:
    return parts.groupBy("map", "r").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))


def per_map(key: Column, column: Column, models: Mapping[str, tuple], fn: Callable[[np.ndarray, tuple], np.ndarray]) -> Column:
    """ARRAY<DOUBLE> -> ARRAY<DOUBLE> by fn(matrix, model of the row's map); null for maps without a model."""

    @F.arrow_udf("array<double>")
    def run(keys: pa.Array, xs: pa.Array) -> pa.Array:
        coded = keys.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices.fill_null(-1))
        codes = np.where(np.asarray(xs.is_valid()), codes, -1)
        parts, places = [], []
        for c, name in enumerate(names):
            at = np.flatnonzero(codes == c)
            if name in models and len(at):
                own = xs.take(pa.array(at))
                parts.append(list_of(fn(np.asarray(own.flatten(), dtype=np.float64).reshape(len(at), -1), models[name])))
                places.append(at)
        if not parts:
            return pa.nulls(len(xs), pa.list_(pa.float64()))
        back = np.full(len(xs), -1, dtype=np.int64)
        back[np.concatenate(places)] = np.arange(sum(map(len, places)))
        return pa.concat_arrays(parts).take(pa.array(np.where(back < 0, 0, back), mask=back < 0))

    return run(key, column.cast("array<double>"))


# ---- principal axes ---------------------------------------------------------

def _axes(moments: np.ndarray, k: int) -> PrincipalAxes:
    p, n = moments.shape[1] - 1, moments[-1, -1]
    mean, second = moments[-1, :-1] / n, moments[:-1, :-1]
    value, vector = np.linalg.eigh((second - n * np.outer(mean, mean)) / max(n - 1, 1))
    value, vector = np.maximum(value[::-1], 0.0), upward(vector[:, ::-1])
    k = min(k, p)
    leading = np.linalg.eigh(second)[1][:, ::-1][:, :k]
    return PrincipalAxes(mean, vector[:, :k], value[:k], value[:k] / max(value.sum(), 1e-300), leading, int(n))


def l1_rows(x: np.ndarray) -> np.ndarray:
    """Rows by their sums, small sums floored."""
    return x / np.maximum(np.abs(x).sum(1, keepdims=True), 1e-12)


def _pca_by_moments(source: Source, names: Sequence[str], k: int, change: Change | None) -> dict[str, PrincipalAxes]:
    """One job: second moments, added up and solved on Spark when they are many."""

    def product(x: np.ndarray, _: tuple) -> np.ndarray:
        x = x if change is None else change(x)
        return np.vstack([np.append(x.T @ x, x.sum(0)[:, None], 1), np.append(x.sum(0), len(x))[None, :]])

    models = {m: (source.sizes[m][1],) for m in names}
    if not isinstance(source, Blocks) or source.few(sum((p + 1) ** 2 for p, in models.values())):
        return {m: _axes(x, k) for m, x in source.sums(models, product, lambda m: (m[0] + 1) ** 2).items()}

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("r")
        a = _axes(np.asarray(rows.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(rows.num_rows, -1), k)
        return pa.table([rows.column("map")[:1], pa.array([pickle.dumps(a)], pa.binary())], ["map", "model"])

    solved = _by_spark(source.partial(models, product)).groupBy("map").applyInArrow(solve, "map string, model binary")
    return {r["map"]: pickle.loads(r["model"]) for r in solved.collect()}


def _pca_by_projection(source: Source, names: Sequence[str], k: int, change: Change | None, extra: int = 10, passes: int = 40,
                       tol: float = 1e-11) -> dict[str, PrincipalAxes]:
    """Wide spectra: a random subspace is turned towards the principal axes pass by pass until the variances stay.

    Each pass sums the channels' products with the projected pixels, channels x (k + `extra`), and carries a tree of
    small QR factorisations of the projected pixels, whose singular values give the variances without squaring them.
    The axes of the centred and of the plain spectra share the passes.
    """

    def first(x: np.ndarray, _: tuple) -> np.ndarray:
        x = x if change is None else change(x)
        return np.vstack([x.sum(0), np.append([len(x), (x * x).sum()], np.zeros(max(x.shape[1] - 2, 0)))])

    models: dict[str, tuple] = {m: (source.sizes[m][1],) for m in names}
    sums = source.sums(models, first, lambda m: 2 * m[0])
    rng = np.random.default_rng(7)
    state, total, before = {}, {}, {}
    for m, (s, tail) in sums.items():
        p, n = len(s), tail[0]
        width = min(k + extra, p)
        mean = s / n
        total[m] = max(tail[1] - n * float(mean @ mean), 0.0)
        q = np.linalg.qr(rng.standard_normal((p, width)))[0]
        state[m] = (mean, q, q.copy())
    done: dict[str, tuple] = {}
    last: dict[str, tuple] = {}

    def turn(x: np.ndarray, model: tuple) -> np.ndarray:
        mean, q, u = model
        x = x if change is None else change(x)
        centred = x - mean
        return np.hstack([centred.T @ (centred @ q), x.T @ (x @ u)])

    for _ in range(passes):
        active = {m: s for m, s in state.items() if m not in done}
        if not active:
            break
        for m, z in source.sums(active, turn, lambda s: 2 * s[1].size).items():
            mean, q, u = state[m]
            w = q.shape[1]
            values = np.linalg.eigvalsh((q.T @ z[:, :w] + z[:, :w].T @ q) / 2)[::-1][:k]
            plain = np.linalg.eigvalsh((u.T @ z[:, w:] + z[:, w:].T @ u) / 2)[::-1][:k]
            both = np.concatenate([values / max(values[0], 1e-300), plain / max(plain[0], 1e-300)])
            state[m] = (mean, np.linalg.qr(z[:, :w])[0], np.linalg.qr(z[:, w:])[0])
            if m in before and np.abs(both - before[m]).max(initial=0.0) <= tol:
                done[m] = state[m]
            before[m] = both
        last = state

    out = {}
    factors = source.factors(last, change)
    for m, (r, r_plain) in factors.items():
        mean, q, u = last[m]
        n = source.sizes[m][0]
        _, s, v = np.linalg.svd(r)
        c = min(k, q.shape[1])
        variance = (s ** 2 / max(n - 1, 1))[:c]
        out[m] = PrincipalAxes(mean, upward((q @ v.T)[:, :c]), variance, variance / max(total[m] / max(n - 1, 1), 1e-300),
                               (u @ np.linalg.svd(r_plain)[2].T)[:, :c], n)
    return out


def fit_pca(source: Source, k: int = 3, names: Sequence[str] | None = None, change: Change | None = None) -> dict[str, PrincipalAxes]:
    """Centred PCA of every map, and the leading directions of its plain spectra; the largest loading is positive.

    `change` is applied to the rows of every block first.
    """
    names = list(source.sizes) if names is None else list(names)
    narrow = [m for m in names if source.sizes[m][1] <= MAX_CHANNELS]
    wide = [m for m in names if source.sizes[m][1] > MAX_CHANNELS]
    out = _pca_by_moments(source, narrow, k, change) if narrow else {}
    return out | (source.each(wide, lambda own, found: _pca_by_projection(own, found, k, change)) if wide else {})


# ---- k-means ----------------------------------------------------------------

def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre and its squared distance; centres are runs x k x dimensions, the results runs x rows."""
    square = (x * x).sum(1)[None, :, None] + (centres * centres).sum(2)[:, None, :] - 2.0 * np.einsum("nd,rkd->rnk", x, centres)
    label = square.argmin(2)
    return label, np.maximum(np.take_along_axis(square, label[:, :, None], 2)[:, :, 0], 0.0)


def fit_kmeans(source: Source, k: int = 4, seed: int = 0, runs: int = 4, steps: int = 50) -> dict[str, np.ndarray]:
    """Centres of every map: `runs` starts side by side, each moved until the centres stay; the start with least error wins.

    Starts are drawn one centre a pass with a chance in proportion to the squared distance from those drawn: the row
    with the highest of log(distance) plus noise from a hash of the row. A map with fewer different pixels than `k` gets
    as many centres.
    """
    return source.each(list(source.sizes), lambda own, names: _fit_kmeans(own, names, k, seed, runs, steps))


def _fit_kmeans(source: Source, names: list[str], k: int, seed: int, runs: int, steps: int) -> dict[str, np.ndarray]:
    def draw(x: np.ndarray, model: tuple) -> np.ndarray:
        centres, round_ = model
        weight = np.ones((runs, len(x))) if not centres.shape[1] else _nearest(x, centres)[1]
        bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
        h = (bits * (np.arange(x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))).sum(1, dtype=np.uint64)
        h = h[None, :] + (np.arange(runs, dtype=np.uint64) * np.uint64(1000003) + np.uint64(round_ * 7919 + seed * 104729 + 1))[:, None]
        for _ in range(2):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        with np.errstate(divide="ignore"):
            score = np.log(weight) - np.log(-np.log(u))
        best = score.argmax(1)
        return np.hstack([score[np.arange(runs), best][:, None], x[best]])

    def product(x: np.ndarray, model: tuple) -> np.ndarray:
        c, = model
        label, distance = _nearest(x, c)
        out = np.zeros((runs, c.shape[1], x.shape[1] + 2))
        for r in range(runs):
            one = np.eye(c.shape[1])[label[r]]
            out[r, :, :-2] = one.T @ x
            out[r, :, -2] = one.sum(0)
            out[r, :, -1] = distance[r] @ one
        return out.reshape(runs * c.shape[1], -1)

    centres = {m: np.zeros((runs, 0, source.sizes[m][1])) for m in names}
    for round_ in range(k):
        for m, rows in source.highest({m: (centres[m], round_) for m in names}, draw).items():
            if np.isfinite(rows[:, 0]).all():  # else no row is left that is not a centre
                centres[m] = np.concatenate([centres[m], rows[:, None, 1:]], axis=1)

    active = {m: (c,) for m, c in centres.items() if c.shape[1]}
    error: dict[str, np.ndarray] = {}
    for _ in range(steps):
        if not active:
            break
        for m, s in source.sums(active, product, lambda c: c[0].shape[0] * c[0].shape[1] * (c[0].shape[2] + 2)).items():
            c, = active[m]
            s = s.reshape(runs, c.shape[1], -1)
            moved = np.where(s[:, :, -2:-1] > 0, s[:, :, :-2] / np.maximum(s[:, :, -2:-1], 1), c)
            error[m] = s[:, :, -1].sum(1)
            if np.abs(moved - c).max() <= 1e-4 * max(np.abs(c).max(), 1e-300):
                del active[m]
            else:
                active[m] = (moved,)
            centres[m] = moved
    best = {m: c[int(error[m].argmin())] if m in error else c[0] for m, c in centres.items()}
    return {m: c[np.lexsort(c.T[::-1])] for m, c in best.items()}  # in order, so that numbers do not depend on the draw


def cluster(df: DataFrame, centres: Mapping[str, np.ndarray], maps: Sequence[str] = (), scores: str = "scores", out: str = "cluster") -> DataFrame:
    """Number of the nearest centre of the row's map."""
    label = per_map(map_key(maps), F.col(scores), {m: (c,) for m, c in centres.items()}, lambda x, c: _nearest(x, c[0][None])[0][0][:, None].astype(float))
    return df.withColumn(out, F.get(label, F.lit(0)).cast("int"))


# ---- alternating factorisations ---------------------------------------------

def _alternate(source: Source, starts: Mapping[str, np.ndarray], exact: bool, iterations: int, tol: float) -> dict[str, Factorisation | None]:
    """One job a pass for all maps that have not stopped: amounts, their products and the residual. None: broke down."""
    amounts = nnls_rows if exact else ols_clip

    def product(x: np.ndarray, model: tuple) -> np.ndarray:
        s, = model
        c = amounts(x, s)
        e = x - c @ s
        tail = np.zeros(sum(s.shape))
        tail[:4] = (e * e).sum(), (x * x).sum(), x.sum(), x.size
        return np.vstack([np.hstack([c.T @ c, c.T @ x]), tail])

    active = {m: (np.maximum(s, 0.0),) for m, s in starts.items()}
    out: dict[str, Factorisation | None] = {}
    previous: dict[str, float] = {}
    for done in range(1, iterations + 1):
        sums = source.sums(active, product, lambda m: (m[0].shape[0] + 1) * sum(m[0].shape)) if active else {}
        for name in list(active):
            s, m = active[name][0], sums.get(name)
            k = len(s)
            gram = None if m is None else m[:k, :k]
            if m is None or not np.isfinite(m).all() or np.linalg.matrix_rank(gram) < k:
                out[name] = None
                del active[name]
                continue
            resid, total = m[k, 0], m[k, 1] - m[k, 2] ** 2 / m[k, 3]
            r2 = 1.0 - resid / max(total, 1e-300)
            if name in previous and abs(previous[name] - resid) <= tol * max(previous[name], 1e-300):
                out[name] = Factorisation(s, done, resid, r2, True)
                del active[name]
                continue
            previous[name] = resid
            steady = gram + 1e-12 * np.trace(gram) * np.eye(k)
            s = nnls_gram(steady, m[:k, k:].T).T if exact else np.maximum(np.linalg.solve(steady, m[:k, k:]), 0.0)
            out[name] = Factorisation(s, done, resid, r2, False)
            active[name] = (s,)
            if (np.abs(s).sum(1) == 0).any():
                out[name] = None
                del active[name]
    return out


def fit_nmf(source: Source, k: Mapping[str, int] | int, iterations: int = 500, tol: float = 1e-6, strict: bool = True) -> dict[str, Factorisation | None]:
    """Non-negative factorisation of every map by alternating exact NNLS from the sign-split singular vectors.

    `k` may differ by map. A map that loses a component raises, or gives None when not `strict`.
    """
    wanted = dict(k) if isinstance(k, Mapping) else dict.fromkeys(source.sizes, k)
    out = source.each(list(wanted), lambda own, names: _fit_nmf(own, {m: wanted[m] for m in names}, iterations, tol))
    short = [m for m in wanted if out.get(m) is None]
    if strict and short:
        raise ValueError("factorisation lost a component; use fewer components")
    return out | dict.fromkeys(short)


def _fit_nmf(source: Source, wanted: dict[str, int], iterations: int, tol: float) -> dict[str, Factorisation | None]:
    lead = {m: a.leading[:, :wanted[m]] for m, a in fit_pca(source, max(wanted.values()), list(wanted)).items()}

    def sides(x: np.ndarray, model: tuple) -> np.ndarray:
        u = x @ model[0]
        return np.vstack([(np.maximum(u, 0) ** 2).sum(0), (np.maximum(-u, 0) ** 2).sum(0)])

    starts = {}
    for m, s in source.sums({m: (v,) for m, v in lead.items()}, sides, lambda v: 2 * v[0].shape[1]).items():
        up, down = np.sqrt(s)
        v = lead[m]
        start = np.empty(v.shape[::-1])
        for j in range(len(start)):
            pos, neg = np.maximum(v[:, j], 0), np.maximum(-v[:, j], 0)
            start[j] = pos if up[j] * np.linalg.norm(pos) >= down[j] * np.linalg.norm(neg) else neg
        start[0] = np.abs(v[:, 0])
        starts[m] = start + 1e-9 * np.abs(start).max()
    out = _alternate(source, starts, True, iterations, tol)
    return {m: f if f is not None and len(f.spectra) == wanted[m] else None for m, f in out.items()}


def fit_mcr(source: Source, starts: Mapping[str, np.ndarray], iterations: int = 50, tol: float = 1e-6, strict: bool = True) -> dict[str, Factorisation | None]:
    """Alternating least squares with clipping for every map with a start; NMF for the maps where it breaks down."""
    inside = {m: np.asarray(s, float) for m, s in starts.items() if m in source.sizes}
    if strict and len(inside) < len(starts):
        raise ValueError("no spectra")
    out = source.each(list(inside), lambda own, names: _alternate(own, {m: inside[m] for m in names}, False, iterations, tol))
    broken = {m: len(inside[m]) for m in inside if out.get(m) is None}
    for m, f in (fit_nmf(source, broken, strict=strict) if broken else {}).items():
        if f is not None:
            f.fallback = True
        out[m] = f
    return out


def concentrations(column: Column, models: Mapping[str, Factorisation], maps: Sequence[str] = (), exact: bool = False) -> Column:
    """Amounts of every pixel on the components of its map."""
    use = nnls_rows if exact else ols_clip
    return per_map(map_key(maps), column, {m: (f.spectra,) for m, f in models.items() if f is not None}, lambda x, s: use(x, s[0]))


def scores(column: Column, models: Mapping[str, PrincipalAxes], maps: Sequence[str] = (), change: Change | None = None) -> Column:
    """Principal scores of every pixel on the axes of its map; `change` as in the fit."""
    plain = {m: (a.mean, a.axes) for m, a in models.items()}
    return per_map(map_key(maps), column, plain, lambda x, a: ((x if change is None else change(x)) - a[0]) @ a[1])


def waves(spectra: DataFrame, maps: Sequence[str], values: int, most: int | None = None) -> int:
    """Waves into which maps whose models have `values` numbers each are dealt by a hash of their key."""
    if not maps:
        return 1
    n = spectra.select(*maps).distinct().count()
    return max(1, -(-8 * values * n // (most or WAVE_BYTES)))
