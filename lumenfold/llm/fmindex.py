"""Benchmark decontamination with an FM-index for each shard of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import ALNUM, Words, free_name, pieces, written

#: Words in a window; bytes of documents in a shard; bytes of benchmark text that are searched in one pass.
WINDOW, SHARD_BYTES, BLOCK_BYTES = 13, 4 << 20, 16 << 20
#: A suffix position in so many is stored.
SAMPLED = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with running counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, largest: int) -> None:
        self._levels = []
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            counts = np.zeros(len(symbols) + 1, dtype=np.int64)
            np.cumsum(ones, out=counts[1:])
            self._levels.append((bit, counts, len(symbols) - int(counts[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        first = np.zeros_like(places)
        for bit, counts, zeros in self._levels:
            one = (symbols >> bit & 1).astype(bool)
            a, b = counts[first], counts[places]
            first = np.where(one, zeros + a, first - a)
            places = np.where(one, zeros + b, places - b)
        return places - first


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by doubling; the last symbol is the smallest and occurs once."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.zeros(n, dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], symbols[order][1:] != symbols[order][:-1]]))
    step = 1
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        step *= 2
    return order


class FMIndex:
    """Counts and places of phrases in a sequence of symbols from 1 on, by backward search."""

    def __init__(self, symbols: np.ndarray) -> None:
        text = np.append(symbols, 0)
        order = suffix_array(text)
        self._last = text[order - 1]
        largest = int(text.max())
        self._before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        self._ranks = WaveletMatrix(self._last, largest)
        self._largest = largest
        marked = order % SAMPLED == 0
        self._mark = np.concatenate([[0], np.cumsum(marked)])
        self._samples = order[marked]
        self._marked = marked

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffix order that begin with each phrase; phrases are the rows of a matrix."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), len(self._last), dtype=np.int64)
        live = np.flatnonzero(phrases.max(axis=1, initial=0) <= self._largest)
        high[phrases.max(axis=1, initial=0) > self._largest] = 0
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            low[live] = self._before[c] + self._ranks.rank(c, low[live])
            high[live] = self._before[c] + self._ranks.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place of each row's suffix: steps back through the text until a stored place is met."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        left = np.flatnonzero(~self._marked[rows])
        while len(left):
            c = self._last[rows[left]]
            rows[left] = self._before[c] + self._ranks.rank(c, rows[left])
            steps[left] += 1
            left = left[~self._marked[rows[left]]]
        return self._samples[self._mark[rows]] + steps


class Phrases:
    """Distinct windows of a block of benchmark items, as rows of word codes from 2 on, with the items of each."""

    def __init__(self, items: pa.Array, texts: pa.Array, window: int = WINDOW) -> None:
        words = Words(texts, ALNUM)
        self.words = np.unique(words.hashes)
        codes = np.searchsorted(self.words, words.hashes) + 2
        ids = np.asarray(items, dtype=np.int64)
        rows: dict[int, list[np.ndarray]] = {}
        owner: dict[int, list[np.ndarray]] = {}
        for i in range(len(ids)):
            own = codes[words.docs[i]:words.docs[i + 1]]
            if len(own):
                size = min(window, len(own))
                rows.setdefault(size, []).append(np.lib.stride_tricks.sliding_window_view(own, size))
                owner.setdefault(size, []).append(np.full(len(own) - size + 1, ids[i]))
        #: For each length: the windows, and for each of them a stretch of `items`.
        self.by_length = []
        for size in sorted(rows):
            table, which = np.unique(np.concatenate(rows[size]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner[size])]), axis=1)
            self.by_length.append((size, table, np.searchsorted(pairs[0], np.arange(len(table) + 1)), pairs[1]))
        self.shortest = min(rows, default=0)


def _expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers start, start + 1, ... of stretches, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """For each word whether a window covers it, and distinct (text, item) pairs as two rows.

    Words that no item has cannot be part of a window. They and the ends of texts part the sequence, and stretches
    shorter than the shortest window are left out; the rest is indexed.
    """
    covered = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    none = np.zeros((2, 0), dtype=np.int64)
    if not len(phrases.words) or not len(words.hashes):
        return covered[:-1] > 0, none
    found = np.minimum(np.searchsorted(phrases.words, words.hashes), len(phrases.words) - 1)
    known = phrases.words[found] == words.hashes
    cut = np.ones(len(known) + 1, dtype=bool)
    cut[1:-1] = known[1:] != known[:-1]
    cut[words.docs] = True
    places = np.flatnonzero(cut)
    stretch = np.flatnonzero(known[places[:-1]] & (np.diff(places) >= phrases.shortest))
    if not len(stretch):
        return covered[:-1] > 0, none
    starts, lengths = places[stretch], places[stretch + 1] - places[stretch]
    origin = _expand(starts, lengths + 1)  # one more for the symbol 1 that ends a stretch
    symbols = np.where(np.arange(len(origin)) == np.repeat(np.cumsum(lengths + 1) - 1, lengths + 1), 1, found[np.minimum(origin, len(found) - 1)] + 2)
    index, pairs = FMIndex(symbols), [none]
    text = np.searchsorted(words.docs, np.arange(len(words.hashes)), "right") - 1
    for size, table, owners, items in phrases.by_length:
        low, high = index.search(table)
        seen = np.flatnonzero(high > low)
        at = origin[index.locate(_expand(low[seen], (high - low)[seen]))]
        which = np.repeat(seen, (high - low)[seen])
        np.add.at(covered, at, 1)
        np.add.at(covered, at + size, -1)
        both = np.unique(np.stack([text[at], which]), axis=1)
        count = owners[both[1] + 1] - owners[both[1]]
        pairs.append(np.stack([np.repeat(both[0], count), items[_expand(owners[both[1]], count)]]))
    return np.cumsum(covered[:-1]) > 0, np.unique(np.concatenate(pairs, axis=1), axis=1)


def _spans(covered: np.ndarray) -> list[dict]:
    """Merged stretches of covered words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]


_FOUND = "doc_id long, text_hash long, n_words long, spans array<struct<start: long, end: long>>, items array<long>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(rows: DataFrame, phrases: Phrases, all_rows: bool) -> DataFrame:
    """One search of all documents for one block of phrases; the block is bounded and travels with the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SHARD_BYTES):
            words = Words(batch.column("text"), ALNUM)
            covered, pairs = hits(words, phrases)
            n = batch.num_rows
            at = np.searchsorted(pairs[0], np.arange(n + 1))
            spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
            for i in np.unique(pairs[0]).tolist():
                spans[i] = _spans(covered[words.docs[i]:words.docs[i + 1]])
                items[i] = pairs[1][at[i]:at[i + 1]].tolist()
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(words.docs), pa.int64()),
                 pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_words", "spans", "items"])
            yield out if all_rows else out.filter(pa.array(np.diff(at) > 0))

    return rows.mapInArrow(run, _FOUND)


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark's distinct items in blocks of about `block_bytes`; the driver holds one block at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null").distinct()
    count = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for k in range(count):
        table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).toArrow().combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
        yield Phrases(columns[0], columns[1], window)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Occurrences of benchmark windows in documents: doc_id, text_hash, n_words, spans and items of each document.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A window is `window` consecutive
    words of an item, or all words of a shorter one. spans are the merged stretches [start, end) of document words that
    windows cover; items the item_ids that occur. Words are compared by 64-bit hashes.

    Documents are searched in shards where they are read. A benchmark of one block costs one pass and no shuffle; of
    more blocks, one pass each, and the parts found are merged by document. Null and empty texts have no words and
    nulls among items are ignored; repeated rows give repeated rows; an empty benchmark hits nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    base, more = None, []
    for phrases in _blocks(benchmark, window, block_bytes):
        if base is None:
            base = _pass(rows, phrases, True)
        else:
            more.append(written(_pass(rows, phrases, False), "hits"))
    if not more:
        return base
    found = more[0]
    for x in more[1:]:
        found = found.union(x)
    found = found.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "s", "i")
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    none_s, none_i = F.array().cast("array<struct<start: bigint, end: bigint>>"), F.array().cast("array<bigint>")
    both = both.select("doc_id", "text_hash", "n_words", F.concat("spans", F.coalesce("s", none_s)).alias("spans"),
                       F.array_distinct(F.concat("items", F.coalesce("i", none_i))).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans, n in zip(batch.column("spans").to_pylist(), batch.column("n_words").to_pylist(), strict=True):
                covered = np.zeros(n if spans else 0, dtype=bool)
                for x in spans:
                    covered[x["start"]:x["end"]] = True
                out.append(_spans(covered))
            yield batch.set_column(3, "spans", pa.array(out, _SPAN))

    return both.mapInArrow(merge, _FOUND)


def report(found: DataFrame) -> DataFrame:
    """Counts and the verdict of each document: contaminated when windows cover at least a twentieth of its words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    names = F.array_sort(F.transform(F.array_distinct("items"), lambda x: x.cast("string")))
    rows = found.withColumn("n_hit", n_hit)
    return rows.select("doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
                       ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), "spans", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, without contaminated ones (see `report`); the others stay as they are."""
    if not _fits(benchmark, block_bytes):
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
        bad = scan(docs, benchmark, window, block_bytes).where((n_hit > 0) & (n_hit * 20 >= F.col("n_words")))
        id_, text_ = free_name("_gone_id", docs.columns), free_name("_gone_text", docs.columns)
        bad = bad.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(text_)).distinct()
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text_))
        return docs.join(bad, same, "left_anti")
    phrases = next(_blocks(benchmark, window, block_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SHARD_BYTES):
            words = Words(batch.column("text"), ALNUM)
            covered, _ = hits(words, phrases)
            total = np.concatenate([[0], np.cumsum(covered)])
            n_hit = total[words.docs[1:]] - total[words.docs[:-1]]
            yield batch.filter(pa.array(~((n_hit > 0) & (n_hit * 20 >= np.diff(words.docs)))))

    return docs.mapInArrow(run, docs.schema)


def _fits(benchmark: DataFrame, block_bytes: int) -> bool:
    return (benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) <= block_bytes
