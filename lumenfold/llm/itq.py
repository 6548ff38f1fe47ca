"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import written
from lumenfold.llm.components import connected_components

#: Vectors for fitting, at most; tables, bits of the code in each; vectors of a bucket that are compared in one block.
FITTED, TABLES, WIDTH, BLOCK = 20_000, 10, 12, 1024


def _matrix(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which values are usable vectors (not null, no null or non-finite component, not zero), and those vectors."""
    ok, vectors = np.zeros(len(column), dtype=bool), []
    offsets = np.asarray(column.offsets, dtype=np.int64)
    valid = np.asarray(column.is_valid())
    values = column.values.cast(pa.float64())
    holes = np.asarray(values.is_null())
    flat = np.asarray(values.fill_null(0.0))
    for i in np.flatnonzero(valid).tolist():
        a, b = offsets[i], offsets[i + 1]
        x = flat[a:b]
        norm = np.abs(x).max() if b > a else 0.0
        if not holes[a:b].any() and np.isfinite(x).all() and norm > 0:
            ok[i] = True
            vectors.append(x + 0.0)  # no negative zeros
    return ok, vectors


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn_rotations(sample: np.ndarray, bits: int, steps: int = 50, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projections (dimensions x bits) whose signs are balanced codes.

    Each set of at most `dimensions` bits starts from principal directions under a random rotation and alternates
    between the nearest signs and the nearest rotation. More bits than dimensions take further starts.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    x = sample - mean
    d = x.shape[1]
    _, vectors = np.linalg.eigh(x.T @ x / max(len(x), 1))
    parts, left = [], bits
    while left > 0:
        n = min(d, left)
        base = vectors[:, ::-1][:, :n]
        v = x @ base
        r = np.linalg.qr(rng.standard_normal((n, n)))[0]
        for _ in range(steps):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(base @ r)
        left -= n
    return mean, np.concatenate(parts, axis=1)


def codes(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray, tables: int, width: int) -> np.ndarray:
    """The code of each vector, cut into one number for each table."""
    signs = ((unit - mean) @ projection >= 0).reshape(len(unit), tables, width)
    return (signs << np.arange(width)).sum(axis=2).astype(np.int32)


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the symmetric matrix connects: all of a component with its first member."""
    left, a, b = linked.any(axis=1), [], []
    while left.any():
        root = int(left.argmax())
        left[root] = False
        frontier = np.array([root])
        while len(frontier):
            near = linked[frontier].any(axis=0) & left
            frontier = np.flatnonzero(near)
            left[frontier] = False
            a.append(np.full(len(frontier), root))
            b.append(frontier)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _rerank(table: int, own: np.ndarray, parts: np.ndarray, unit: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of a bucket are links: cosine of the original vectors, and no earlier table holds the pair.

    own marks the vectors of the first of two blocks; with two blocks only pairs across them count.
    """
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    if not own.all():
        linked &= own[:, None] != own[None, :]
    if linked.any():
        for t in range(table):
            linked &= parts[:, t][:, None] != parts[:, t][None, :]
    return linked


_SCHEMA = "kind int, a long, b long"


def _linked(dealt: DataFrame, least: float, tables: int) -> DataFrame:
    """From rows sorted by bucket: (0, class, links) sums and (1, class, class) spanning pairs of each group."""
    names = ["kind", "a", "b"]

    def group(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        unit = _unit(np.frombuffer(b"".join(rows.column("vector").to_pylist()), dtype="<f8").reshape(rows.num_rows, -1))
        rep, many = (np.asarray(rows.column(c), dtype=np.int64) for c in ("rep", "many"))
        parts = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype="<i4").reshape(rows.num_rows, tables)
        p, q, own = (np.asarray(rows.column(c), dtype=np.int64) for c in ("p", "q", "own"))
        linked = _rerank(int(rows.column("tab")[0].as_py()), own == p if p[0] != q[0] else np.ones(len(own), dtype=bool), parts, unit, least)
        hit = np.flatnonzero(linked.any(axis=1))
        if len(hit):
            sums = linked[hit] @ many
            a, b = _spanning(linked)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(hit), len(a)]).astype(np.int32)),
                                              pa.array(np.concatenate([rep[hit], rep[a]])), pa.array(np.concatenate([sums, rep[b]]))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = np.stack([np.asarray(held.column(c), dtype=np.int64) for c in ("bucket", "p", "q")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            begins = np.concatenate([[0], cuts])
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                if b - a > 1:
                    yield from group(held.slice(a, b - a))
            held = held.slice(begins[-1])
        if held is not None and held.num_rows > 1:
            yield from group(held)

    return dealt.mapInArrow(run, _SCHEMA)


def near_duplicates(rows: DataFrame, least: float = 0.93, tables: int = TABLES, width: int = WIDTH, fitted: int = FITTED,
                    block: int = BLOCK) -> DataFrame:
    """Links of vectors (vec_id, embedding, label) with equal labels and a cosine of at least `least`.

    Returns vec_id, n_links, component_id and kept for every row. The code is learnt on at most `fitted` vectors (those
    of the commonest length with the smallest hashed ids); every vector is indexed under each of its `tables`
    substrings. Vectors that share a substring are compared by their cosine in double precision; a pair counts in the
    first table that holds both. Equal vectors are compared once, as a class. A bucket of more than `block` classes is
    cut into blocks and each pair of blocks is one group, so groups are bounded and no pair of a bucket is left out.

    Null labels, null or zero vectors and vectors with null or non-finite components link with nothing, nor do rows
    without vec_id (n_links 0, their component is themselves) or vectors of different lengths. Repeated rows link like
    other vectors. An empty table gives no rows; other columns are ignored.
    """
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, vectors = _matrix(batch.column("embedding"))
            usable = ok & np.asarray(batch.column("label").is_valid()) & np.asarray(batch.column("vec_id").is_valid())
            out, it = [None] * batch.num_rows, iter(vectors)
            for i in np.flatnonzero(ok).tolist():
                x = next(it)
                out[i] = x.astype("<f8").tobytes() if usable[i] else None
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())],
                                             ["vec_id", "label", "vector"])

    base = base.mapInArrow(clean, "vec_id long, label string, vector binary")
    base = written(base.withColumns({"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64("vector", "label")}), "vectors")
    usable = base.where("vector is not null")
    classes = usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"))
    # one row of each class: the representative's, and one only if its id is repeated
    first = usable.join(classes, ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["h1", "h2"])
    reps = written(first.select("rep", "many", "label", "vector"), "classes")

    size = reps.groupBy(F.octet_length("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return _result(base, None, None)
    sample = reps.where(F.octet_length("vector") == size["n"]).orderBy(F.xxhash64("rep"), "rep").limit(fitted).select("vector").toArrow()
    fit = _unit(np.frombuffer(b"".join(sample.column("vector").to_pylist()), dtype="<f8").reshape(sample.num_rows, -1))
    mean, projection = learn_rotations(fit, tables * width)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            out: list[bytes] = [b""] * len(vectors)
            lengths = np.array([len(v) for v in vectors])
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                unit = _unit(np.frombuffer(b"".join([vectors[i] for i in at]), dtype="<f8").reshape(len(at), -1))
                d = n // 8  # other lengths use as much of the projection as they have, or repeat it
                m, p = (mean, projection) if d == len(mean) else (np.resize(mean, d), np.resize(projection, (d, tables * width)))
                for i, c in zip(at.tolist(), codes(unit, m, p, tables, width), strict=True):
                    out[i] = c.astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "code"])

    indexed = reps.mapInArrow(index, "rep long, many long, label string, vector binary, code binary")
    part = F.expr("transform(sequence(0, {0}), t -> struct(t as tab, substring(code, 4 * t + 1, 4) as part))".format(tables - 1))
    listed = indexed.withColumn("e", F.explode(part))
    listed = listed.select("rep", "many", "vector", "code", F.col("e.tab").alias("tab"),
                           F.xxhash64("label", F.octet_length("vector"), "e.tab", "e.part").alias("bucket"))
    listed = written(listed, "buckets")
    crowd = listed.groupBy("bucket").count().where("count > 1")
    crowd = crowd.select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    placed = listed.join(crowd, "bucket")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("long"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"p": F.least("own", "other").cast("long"), "q": F.greatest("own", "other").cast("long")})
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select("rep", "many", "vector", "code", "tab", "bucket", "own", "p", "q")
    dealt = dealt.repartition(parts, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    found = written(_linked(dealt, least, tables), "links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    roots = connected_components(found.where("kind = 1").select("a", "b"))
    return _result(base, classes.join(links, "rep", "left"), roots.select(F.col("node").alias("rep"), "component"))


def _result(base: DataFrame, classes: DataFrame | None, roots: DataFrame | None) -> DataFrame:
    if classes is None:
        out = base.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    else:
        known = classes.join(roots, "rep", "left").select(
            F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.coalesce("linked", F.lit(0)) + F.col("many") - 1).alias("n"),
            F.coalesce("component", "rep").alias("c"))
        same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("vector").isNotNull()
        out = base.join(known, same, "left").withColumns({"n_links": F.coalesce("n", F.lit(0)).cast("long"),
                                                          "component_id": F.coalesce("c", "vec_id")})
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
