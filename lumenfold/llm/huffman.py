"""Token files: canonical length-limited Huffman codes from global counts, decoded by table from bit checkpoints."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import pieces, remove
from lumenfold.llm.tokens import default_path, encoder
from lumenfold.session import scratch_path

#: Ids in a block before it is closed at the end of a document; ids between two bit checkpoints; longest code in bits.
BLOCK, INTERVAL, LONGEST = 1 << 16, 128, 20
#: Bytes of text tokenized together and words remembered; more than elsewhere, as a task holds nothing but a block besides.
TOKEN_BYTES, REMEMBERED = 8 << 20, 350_000
_HEAD = struct.Struct("<4sBIQQ")
_MAGIC = b"LFH1"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code lengths, at most `longest`, of least total size: packages and merges, level by level. 0 for unused symbols."""
    out = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need codes of more than {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64)
    level, leaves = coins, [np.ones(n, dtype=bool)]
    for _ in range(longest - 1):
        packages = level[0:len(level) // 2 * 2:2] + level[1:len(level) // 2 * 2:2]
        both = np.concatenate([coins, packages])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaves.append(order < n)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[used] = lengths
    return out


class Code:
    """A canonical code: codes in order of length, then symbol; `table` maps the next bits to symbol and length."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        self.bits = int(lengths.max()) if len(used) else 1
        share = np.left_shift(1, self.bits - lengths[order].astype(np.int64))
        begin = np.cumsum(share) - share
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[order] = begin >> (self.bits - lengths[order])
        table = np.repeat(order.astype(np.uint64) << np.uint64(6) | lengths[order].astype(np.uint64), share)
        self.table = np.concatenate([table, np.ones((1 << self.bits) - len(table), dtype=np.uint64)])

    def encode(self, ids: np.ndarray, interval: int = INTERVAL) -> bytes:
        lengths = self.lengths[ids]
        if len(ids) and not lengths.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(lengths)
        begins = ends - lengths
        total = int(ends[-1]) if len(ids) else 0
        word, shift = begins >> 5, (64 - lengths - (begins & 31)).astype(np.uint64)
        spread = self.codes[ids] << shift
        count = (total + 31) // 32 + 1
        high = np.bincount(word, (spread >> np.uint64(32)).astype(np.float64), count)
        low = np.bincount(word + 1, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), count + 1)
        words = (high[:count] + low[:count]).astype(np.uint64).astype("<u4")
        marks = begins[::interval].astype("<u8" if total >> 32 else "<u4")
        return _HEAD.pack(_MAGIC, marks.itemsize, interval, len(ids), count) + marks.tobytes() + words.tobytes()

    def decode(self, block: bytes) -> np.ndarray:
        """All ids of a block; the stretches between checkpoints are decoded side by side."""
        magic, width, interval, n, count = _HEAD.unpack_from(block)
        if magic != _MAGIC:
            raise ValueError("not a block of this format")
        lanes = -(-n // interval)
        place = np.frombuffer(block, f"<u{width}", lanes, _HEAD.size).astype(np.int64)
        words = np.frombuffer(block, "<u4", count, _HEAD.size + lanes * width).astype(np.uint64)
        words = np.concatenate([words, np.zeros(interval * self.bits // 32 + 3, dtype=np.uint64)])
        pairs = words[:-1] << np.uint64(32) | words[1:]
        out = np.zeros((interval, lanes), dtype=np.uint32)
        drop = np.uint64(64 - self.bits)
        for k in range(min(interval, n)):
            seen = self.table[(pairs[place >> 5] << (place & 31).astype(np.uint64)) >> drop]
            out[k] = seen >> np.uint64(6)
            place += (seen & np.uint64(63)).astype(np.int64)
        return out.T.ravel()[:n]


def _tokenized(docs: DataFrame, path: str, end_id: int, block: int) -> DataFrame:
    """Blocks of whole documents in ascending doc_id order, and for each task a row with its id counts."""
    schema = "part int, block long, first long, n_ids long, doc_ids array<long>, lengths array<long>, ids binary, counts binary"
    lists = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), lists, lists, pa.binary(), pa.binary()]
    names = ["part", "block", "first", "n_ids", "doc_ids", "lengths", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, REMEMBERED)
        kind = np.dtype("<u2" if max(words.vocabulary, end_id + 1) <= 1 << 16 else "<u4")
        part, number, first = TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(max(words.vocabulary, end_id + 1), dtype=np.int64)
        names_, held, lengths, size = [], [], [], 0

        def row(*values: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in pieces(batches, "text", TOKEN_BYTES):
            ids, places = words.encode(batch.column("text"))
            counts += np.bincount(ids, minlength=len(counts))
            counts[end_id] += batch.num_rows
            ids = ids.astype(kind)
            for i, name in enumerate(batch.column("doc_id").to_pylist()):
                names_.append(name)
                held += [ids[places[i]:places[i + 1]].tobytes(), np.asarray([end_id], kind).tobytes()]
                lengths.append(int(places[i + 1] - places[i]) + 1)
                size += lengths[-1]
                if size >= block:
                    yield row(part, number, first, size, names_, lengths, b"".join(held), None)
                    number, first, names_, held, lengths, size = number + 1, first + size, [], [], [], 0
        if size:
            yield row(part, number, first, size, names_, lengths, b"".join(held), None)
        if counts.any():
            seen = np.flatnonzero(counts)
            yield row(part, None, None, None, None, None, None, np.stack([seen, counts[seen]]).astype("<i8").tobytes())

    return docs.mapInArrow(run, schema)


def _counts(spark: SparkSession, path: str) -> np.ndarray:
    """Global counts by id. The driver gets sixteen sums, each with a number for every id of the vocabulary."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for value in batch.column("counts").to_pylist():
                ids, n = np.frombuffer(value, dtype="<i8").reshape(2, -1)
                own = np.bincount(ids, n, max(len(counts), int(ids[-1]) + 1)).astype(np.int64)
                own[:len(counts)] += counts
                counts = own
        if len(counts):
            yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    rows = spark.read.parquet(path).where("counts is not null").select("counts")
    sums = [np.frombuffer(r["counts"], dtype=np.int64) for r in rows.repartition(16).mapInArrow(total, "counts binary").collect()]
    out = np.zeros(max(map(len, sums), default=1), dtype=np.int64)
    for x in sums:
        out[:len(x)] += x
    return out


def encode_corpus(docs: DataFrame, out: str | None = None, tokenizer: str | None = None, end_id: int = 1,
                  block: int = BLOCK, interval: int = INTERVAL, longest: int = LONGEST) -> str:
    """Writes the ids of every document (doc_id, text), each followed by `end_id`, in ascending doc_id order.

    The folder gets `blocks` and `code`. A row of `blocks` is an independent block of whole documents: its part and
    number, the part's ids before it, document ids and lengths, and a payload of magic, checkpoint interval, bit
    offsets of every interval-th id, and the bit stream. `code` holds the code lengths by id, which define the
    canonical code. Spark's writer commits the files, so lost executors leave no half-written ones.

    Null doc_ids come first, equal doc_ids in the order of the input; null text is empty; other columns are ignored. An
    empty table gives an empty folder of blocks.
    """
    spark = docs.sparkSession
    folder = out or scratch_path(spark, "tokens")
    path = tokenizer or default_path()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row number keeps ranges even when one doc_id holds many rows; it is fixed by the input's splits
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    plain = f"{folder}/plain"
    _tokenized(rows, path, end_id, block).write.parquet(plain)
    lengths = code_lengths(_counts(spark, plain), longest)
    spark.createDataFrame([(lengths.astype(np.uint8).tobytes(),)], "lengths binary").write.parquet(f"{folder}/code")
    code = Code(lengths)
    wide = "<u2" if max(encoder(path).vocabulary, end_id + 1) <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                payload = code.encode(np.frombuffer(one.column("ids")[0].as_py(), dtype=wide).astype(np.int64), interval)
                yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.array([payload], pa.binary())],
                                                 [*one.schema.names[:-1], "payload"])

    blocks = spark.read.parquet(plain).where("counts is null").drop("counts")
    blocks.mapInArrow(encode, "part int, block long, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary") \
        .write.parquet(f"{folder}/blocks")
    remove(spark, plain)
    return folder


def read_corpus(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of a written folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids.

    Blocks are decoded independently. Only one number for each part (a task of the writer) is broadcast.
    """
    table = spark.read.parquet(f"{folder}/code").toArrow()
    code = Code(np.frombuffer(table.column("lengths")[0].as_py(), dtype=np.uint8).astype(np.int64))
    blocks = spark.read.parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.join(F.broadcast(parts.select("part", before.alias("base"))), "part")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids = code.decode(x["payload"]).astype("<u4")
                ends = np.cumsum(x["lengths"])
                begins = ends - np.asarray(x["lengths"])
                own = [ids[a:b].tobytes() for a, b in zip(begins, ends, strict=True)]
                arrays = [pa.array(x["doc_ids"], pa.int64()), pa.array(begins + x["at"], pa.int64()),
                          pa.array(x["lengths"], pa.int64()), pa.array([zlib.crc32(b) for b in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(own, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    rows = blocks.select("doc_ids", "lengths", "payload", (F.col("base") + F.col("first")).alias("at"))
    return rows.mapInArrow(decode, schema)
