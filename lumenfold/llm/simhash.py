"""SimHash near-duplicates through an inverted index of byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import free_name, pieces, written
from lumenfold.llm.components import connected_components

#: Fingerprints of one posting list that are compared in one group; longer lists are compared block against block.
BLOCK = 8192
_PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))


def position_sets() -> list[tuple[int, int, int]]:
    """Twenty triples of byte positions such that any four of the eight positions contain one of them.

    Fingerprints that agree in four bytes or more thus meet in a list for one triple. Lists for single bytes would
    hold 1/256 of all fingerprints each and their pairs would grow with the square of the input.
    """
    inner = [t for p in _PARTS for t in combinations(p, 3)]
    outer = [(*two, one) for k, p in enumerate(_PARTS) for two in combinations(p, 2) for one in _PARTS[(k + 1) % 3]]
    return inner + outer


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): 64-bit SimHash of each whole text over its word shingles, repeats included.

    A-Z are lower-cased, words end at ASCII white space. A text of fewer words is one shingle, one without words has
    fingerprint 0. text_hash tells rows with one doc_id and different texts apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_digest as digest
        for batch in pieces(batches, "text"):
            values = np.zeros(batch.num_rows, dtype=">i8")
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").lower().split()
                if not words:
                    continue
                joined = b" ".join(words)
                if len(words) <= shingle:
                    hashes = digest(joined, 42)
                else:
                    ends = np.cumsum([len(w) + 1 for w in words])
                    begins = np.concatenate([[0], ends[:-shingle]]).tolist()
                    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(begins, (ends[shingle - 1:] - 1).tolist(), strict=True)])
                bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
                ones = bits.sum(axis=0, dtype=np.int64)
                values[i:i + 1] = np.packbits(ones * 2 > len(bits)).view(">i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(values.astype(np.int64))],
                                             ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _matches(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Pairs that share the guaranteed number of positional bytes, then those within the distance."""
    differ = x ^ y
    shared = (differ[:, None].view(np.uint8) == 0).sum(axis=1)
    found = np.flatnonzero(shared >= 8 - distance)
    return found[np.bitwise_count(differ[found]) <= distance]


def _spanning(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever the links within one group connect: a breadth-first search over all of it."""
    left, a, b = np.unique(values), [], []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            node, frontier = frontier[0], frontier[1:]
            near = np.zeros(len(left), dtype=bool)
            near[_matches(left, np.full(len(left), node), distance)] = True
            if near.any():
                a.append(np.full(int(near.sum()), node))
                b.append(left[near])
                frontier, left = np.concatenate([frontier, left[near]]), left[~near]
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _edges_of(groups: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of many groups, which lie end to end. Small groups are compared side by side, shift by shift."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    lengths = np.diff(np.append(starts, len(groups)))
    a, b = [], []
    for s, n in zip(starts[lengths > 48].tolist(), lengths[lengths > 48].tolist(), strict=True):
        x, y = _spanning(values[s:s + n], distance)
        a.append(x)
        b.append(y)
    small = np.repeat(lengths <= 48, lengths)
    groups, values = groups[small], values[small]
    for shift in range(1, 48):
        at = np.flatnonzero(groups[shift:] == groups[:-shift])
        if not len(at):
            break
        at = at[_matches(values[at], values[at + shift], distance)]
        a.append(values[at])
        b.append(values[at + shift])
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(prints: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between different fingerprints that connect exactly what links of `distance` bits connect.

    The index lists each distinct fingerprint under its bytes at every position set. A list of more than `block`
    fingerprints is cut into blocks, and each pair of blocks is one group, so a group is bounded and all pairs of a list
    are still compared. Only spanning edges leave a group.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the position sets guarantee a meeting up to 4 differing bits")
    byte = [f"(shiftrightunsigned(fp, {8 * p}) & 255)" for p in range(8)]
    keys = [f"{k << 24}L | ({byte[x]} << 16) | ({byte[y]} << 8) | {byte[z]}" for k, (x, y, z) in enumerate(position_sets())]
    listed = prints.select("fp").distinct().select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))
    long = listed.groupBy("key").count().where(F.col("count") > block)
    long = long.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    placed = listed.join(long, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.select("fp", "key", own.alias("own"), other.alias("other"))
    placed = placed.select("fp", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), dtype=np.int64)

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate([[False], (rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)])) if len(rows) else rows[:, 0]
            a, b = _edges_of(group, rows[:, 0].copy().view(np.uint64), distance) if len(rows) else (rows[:, 0], rows[:, 0])
            both = np.unique(np.stack([a.view(np.int64), b.view(np.int64)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch in batches:
            rows = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in ("fp", "key", "p", "q")], axis=1)
            held = np.concatenate([held, rows])
            if len(held) < 1 << 16:
                continue
            same = (held[:, 1:] == held[-1, 1:]).all(axis=1)
            open_from = len(held) - int(same.sum())  # the last group may go on in the next batch
            if open_from:
                yield edges(held[:open_from])
                held = held[open_from:]
        if len(held):
            yield edges(held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _prints_and_roots(docs: DataFrame, shingle: int, distance: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Written fingerprints of all rows, and (fp, root) of the fingerprints that have a link."""
    prints = written(fingerprints(docs, shingle), "prints")
    found = written(connected_components(links(prints, distance, block)), "roots")
    return prints, found.select(F.col("node").alias("fp"), F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, text_hash, fp and root, the smallest fingerprint its fingerprint is linked to.

    Copies share a fingerprint and are never compared with each other. Null texts count as empty; documents without
    words have fingerprint 0 and are linked like any other. An empty table gives no rows; other columns are ignored.
    """
    prints, roots = _prints_and_roots(docs, shingle, distance, block)
    return prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(docs: DataFrame, shingle: int = 4, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id reachable over links.

    Rows without doc_id belong to their component and do not name it (null if none of it has a doc_id).
    """
    prints, roots = _prints_and_roots(docs, shingle, distance, block)
    # smallest doc_id of a fingerprint, then of a component: copies are combined before anything is shuffled by group
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The documents, all columns, without those that are near-duplicates of a kept one.

    Of each component the row with the smallest doc_id stays (rows without doc_id come last, ties go to the smaller
    text hash); of rows repeated with one doc_id and text, one stays.
    """
    rows = near_duplicates(docs, shingle, distance)
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    rows = written(rows.select("doc_id", "text_hash", "root", key.alias("key")), "groups")
    first = rows.groupBy("root").agg(F.min("key").alias("first"))
    id_, text_ = free_name("_gone_id", docs.columns), free_name("_gone_text", docs.columns)
    gone = rows.join(first, "root").where("key <> first").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(text_)).distinct()
    text_hash = F.xxhash64(F.col("text").cast("string"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (text_hash == F.col(text_))
    kept = docs.join(gone, same, "left_anti")
    again = rows.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept
