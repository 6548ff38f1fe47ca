"""Helpers of this subpackage: bounded Arrow pieces, word hashes over whole batches, written tables that cut lineage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lumenfold.session import scratch_path

PIECE_BYTES, HASHED = 4 << 20, 1 << 19

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Word bytes of the decontamination rule: digits, letters a-z and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder under the shared one and read back: cuts the lineage and survives lost executors."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same with the folder, for tables that `remove` can drop before the session ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(name: str, columns: list[str]) -> str:
    """`name`, longer by underscores where a column already has it, so that joins never meet two columns of one name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each string or binary value; null counts as empty."""
    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the values of a text column hold about `most` bytes; one longer value comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(sizes(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and the n + 1 places where the values begin; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _pow(base: int, n: int) -> np.ndarray:
    """Powers 0 to n of an odd number modulo 2 ** 64; a longer table replaces a shorter one."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n < 1 << 21:
            _powers[base] = have
    return have[:n + 1]


class Words:
    """Words of a text column, found and hashed for the whole batch at once.

    `hashes` are 64-bit polynomial hashes of the words after lower-casing A-Z; `starts` and `ends` are byte places in
    `raw`; the words of text i are those from `docs[i]` to `docs[i + 1]`.
    """

    def __init__(self, column: pa.Array, word_bytes: np.ndarray = ~SPACE) -> None:
        raw, self.offsets = flat_bytes(column)
        self.raw = raw
        low = _FOLD[raw]
        inside = word_bytes[low]
        edge = np.ones(len(low) + 1, dtype=bool)  # a word ends where the text ends
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[self.offsets] = True
        places = np.flatnonzero(edge)
        words = np.flatnonzero(inside[places[:-1]])
        self.starts, self.ends = places[words], places[words + 1]
        self.docs = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hash(low)

    def _hash(self, low: np.ndarray) -> np.ndarray:
        """Sum of (byte + 1) * base ** place: differences of a running sum, moved to place 0 by the inverse base.

        Worked out for about HASHED bytes at a time, so that the 64-bit numbers do not take many times the text.
        """
        out = np.zeros(len(self.starts), dtype=np.uint64)
        begin = 0
        while begin < len(out):
            first = self.starts[begin]
            end = max(begin + 1, int(np.searchsorted(self.starts, first + HASHED)))
            part = low[first:self.ends[end - 1]]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _pow(_BASE, len(part))[:-1], out=sums[1:])
            at = self.starts[begin:end] - first
            out[begin:end] = (sums[self.ends[begin:end] - first] - sums[at]) * _pow(_INVERSE, len(part))[at]
            begin = end
        return mix(out + mix((self.ends - self.starts).astype(np.uint64)))
