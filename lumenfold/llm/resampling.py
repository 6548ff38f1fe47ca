"""Target-distribution importance resampling: array-scored weights, bracketed cutoff, exact ranks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import ALNUM, flat_bytes, pieces, written

#: Hash buckets of the features; words a document needs to be drawn; rows that a quantile sketch tells apart.
BUCKETS, MIN_WORDS, ACCURACY = 10_000, 20, 10_000
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[~ALNUM[_FOLDED]] = 32  # what is no part of a word becomes a space


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a text column, the words of all texts as their numbers, and the n + 1 places of the texts."""
    raw, offsets = flat_bytes(texts)
    clean = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_FOLDED[raw])])
    split = pc.ascii_split_whitespace(clean.view(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    codes, ends = np.asarray(coded.indices, dtype=np.int64), np.asarray(split.offsets, dtype=np.int64)
    ends = ends - ends[0]
    if b"" in distinct:  # white space at either end of a text leaves an empty string
        keep = codes != distinct.index(b"")
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    return distinct, codes, ends


def features(texts: pa.Array, n_max: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a text column, the n + 1 places where the texts begin, and their numbers of words.

    Features are the runs of 1 to `n_max` words, joined by one space; a bucket is the CRC-32 of the bytes modulo
    `buckets`.
    """
    distinct, codes, places = words_of(texts)
    sums = np.asarray(list(map(zlib.crc32, distinct)), dtype=np.int64)
    n_words = np.diff(places)
    own = sums[codes] % buckets
    if n_max == 1:
        return own, places, n_words
    owner = np.repeat(np.arange(len(n_words)), n_words)
    parts, owners = [own], [owner]
    for n in range(2, n_max + 1):
        runs = np.lib.stride_tricks.sliding_window_view(codes, n) if len(codes) >= n else np.zeros((0, n), dtype=np.int64)
        inside = owner[:len(runs)] == owner[n - 1:n - 1 + len(runs)]
        kinds, which = np.unique(runs[inside], axis=0, return_inverse=True)
        crc = np.asarray([zlib.crc32(b" ".join([distinct[k] for k in run])) for run in kinds.tolist()] or [0], dtype=np.int64)
        parts.append(crc[which] % buckets)
        owners.append(owner[:len(runs)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(len(n_words) + 1)), n_words


def bucket_counts(rows: DataFrame, n_max: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of a table in each bucket. A task gives one number a bucket, Spark adds them up, the driver gets the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in pieces(batches, "text"):
            counts += np.bincount(features(batch.column("text"), n_max, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(counts[seen])], ["bucket", "n"])

    texts = rows.select(F.col("text").cast("string").alias("text"))
    sums = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[np.asarray(sums.column("bucket"), dtype=np.int64)] = np.asarray(sums.column("n"), dtype=np.int64)
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of each of the B buckets."""
    n = len(source)
    high = (target + 1.0) * float(source.sum() + n)
    low = (source + 1.0) * float(target.sum() + n)
    return np.floor(1000.0 * np.log(high / low)).astype(np.int64)


def gumbel(ids: list[int | None], seed: str) -> np.ndarray:
    """floor(-1000 ln(-ln u)) with u from the first 8 hex digits of sha256(seed:id)."""
    u = np.asarray([int.from_bytes(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:4], "big") for i in ids], dtype=np.float64)
    return np.floor(-1000.0 * np.log(-np.log((u + 0.5) / 4294967296.0))).astype(np.int64)


def scored(docs: DataFrame, gains: np.ndarray, seed: str = "2024", n_max: int = 1) -> DataFrame:
    """doc_id, n_features, weight (floored mean gain), score (weight and noise) and n_words of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found, places, n_words = features(batch.column("text"), n_max, len(gains))
            totals = np.concatenate([[0], np.cumsum(gains[found])])
            n = np.diff(places)
            weight = (totals[places[1:]] - totals[places[:-1]]) // np.maximum(n, 1)
            score = weight + gumbel(batch.column("doc_id").to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n, weight, score, n_words))],
                                             ["doc_id", "n_features", "weight", "score", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_features long, weight long, score long, n_words long")


def locate_cutoff(rows: DataFrame, wanted: int, total: int, accuracy: int = ACCURACY) -> int:
    """The score at place `wanted` (from 1 to `total`) of the scores in falling order.

    A mergeable quantile sketch proposes a bracket of scores; exact counts above and inside it either confirm that it
    holds the place or widen it. Only the scores of the bracket are then counted and put in order (equal scores as one
    row), so nothing but integers of the bracket reaches the driver.
    """
    spread = 2.0 / accuracy
    while True:
        share = 1.0 - wanted / total
        ends = [max(0.0, share - spread), min(1.0, share + spread)]
        low, high = rows.agg(F.percentile_approx("score", ends, accuracy)).first()[0]
        outside = rows.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score").between(low, high)).alias("inside")).first()
        if outside["above"] < wanted <= outside["above"] + outside["inside"]:
            break
        spread *= 8
    bracket = rows.where(F.col("score").between(low, high)).groupBy("score").count().orderBy(F.desc("score")).toArrow()
    n = np.asarray(bracket.column("count"), dtype=np.int64)
    upto = outside["above"] + np.cumsum(n)
    return bracket.column("score")[int(np.searchsorted(upto, wanted))].as_py()


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rank 1, 2, 3... by falling score, then rising doc_id (null last), then place.

    Rows are dealt into ranges of that order, numbered in each range and moved by the rows of the ranges before it, of
    which there are as many as shuffle partitions; `place` splits even equal rows.
    """
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id holds the partition in its upper bits, then the row's number there; written, so that both stay as they are
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), "drawn")
    dealt = dealt.withColumns({"range": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)})
    before, base = 0, []
    for r in sorted(dealt.groupBy("range").count().collect()):
        base.append((r["range"], before))
        before += r["count"]
    starts = spark.createDataFrame(base, "range long, base long")
    return dealt.join(F.broadcast(starts), "range").select(*rows.columns, (F.col("base") + F.col("at") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: str = "2024", n_max: int = 1, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, accuracy: int = ACCURACY) -> DataFrame:
    """Draws `percent` % of the documents (doc_id, text) so that they resemble the texts of `target`, without return.

    Features are hashed runs of 1 to `n_max` words. Each bucket's gain compares its share of the target with that of
    the documents; a document's weight is the floored mean gain of its features, and its score adds Gumbel noise that
    depends on `seed` and doc_id only, so the highest scores are a draw by importance. Of the documents with at least
    `min_words` words the highest scores are drawn. Returns every document's doc_id, n_features, weight, score and rank
    (from 1 by falling score, ties by smaller doc_id; null if not drawn).

    Two passes over the texts: bucket counts, then scores, which are written once as five numbers a row. Only bucket
    counts, the scores inside the bracket with their counts, and a number for each range reach the driver.

    A null text has no words (weight 0, never drawn unless `min_words` is 0); a null doc_id counts as the empty string
    in the noise and comes last among equal scores; repeated rows take part each; an empty target gives every feature
    the gain of its rarity in the documents; an empty table gives no rows; other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, n_max, buckets), bucket_counts(target, n_max, buckets))
    rows = written(scored(docs, gains, seed, n_max).withColumn("place", F.monotonically_increasing_id()), "scores")
    able = rows.where(F.col("n_words") >= min_words)
    total = able.count()
    wanted = total * percent // 100
    none = F.lit(None).cast("long")
    if not wanted:
        return rows.select("doc_id", "n_features", "weight", "score", none.alias("rank"))
    high = F.col("score") >= locate_cutoff(able, wanted, total, accuracy)
    # rows with the cutoff's score are ranked together with the higher ones; those beyond `wanted` are not drawn
    top = ranked(able.where(high)).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = rows.where((F.col("n_words") < min_words) | ~high).withColumn("rank", none)
    return top.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
