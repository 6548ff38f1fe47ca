"""Token counts of whole texts: batches balanced by bytes, long texts split where no token can reach across."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import pieces, sizes
from lumenfold.llm.tokens import default_path

#: Bytes of text that are counted together; bytes that the library encodes in one call; bytes from which a text is split.
BATCH_BYTES, CALL_BYTES, SPLIT_BYTES = 4 << 20, 256 << 10, 1 << 20
#: Distinct words whose lengths a worker remembers; it forgets the older half beyond that. Longer words are not kept.
REMEMBERED, LONGEST = 300_000, 64
#: Places after which a new token begins for a tokenizer that drops white space and takes each digit by itself.
_SAFE = re.compile(rb"[ \t\n\r]|[0-9](?=[\x00-\x7f])")
_counters: dict[str, Counter] = {}


def split_safely(raw: bytes, most: int = SPLIT_BYTES) -> list[str]:
    """A UTF-8 text in parts of about `most` bytes, cut behind white space or a digit only.

    The last such place of each stretch is taken; a stretch without any grows to the next one, so a very long word
    stays whole.
    """
    out, start = [], 0
    while len(raw) - start > most:
        end, window = 0, 256
        while not end and window < 2 * most:
            for found in _SAFE.finditer(raw, max(start, start + most - window), start + most):
                end = found.end()
            window *= 8
        if not end:
            found = _SAFE.search(raw, start + most)
            if found is None:
                break
            end = found.end()
        out.append(raw[start:end].decode("utf-8", "replace"))
        start = end
    out.append(raw[start:].decode("utf-8", "replace"))
    return out


def byte_batches(lengths: np.ndarray, most: int = CALL_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with about `most` bytes in each."""
    total = np.cumsum(lengths)
    start = 0
    while start < len(total):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
        yield start, end
        start = end


class Counter:
    """Lengths of texts under one tokenizer file; only numbers leave it."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.splits = False
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._lengths: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._lengths = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        plain = all(re.fullmatch(r"[^\s\d]+", t.content) and not t.lstrip and not t.rstrip for t in tokenizer.get_added_tokens_decoder().values())
        probe = tokenizer.encode_batch([" the\n\t of, A 12b3, ", "the", "of,", "a", "1", "2", "b", "3", ","], add_special_tokens=False)
        self.splits = plain and probe[0].ids == [i for x in probe[1:] for i in x.ids]
        self._new: dict[str, int] = {}
        self._old: dict[str, int] = {}

    def _batched(self, texts: list[str]) -> np.ndarray:
        """Lengths in calls of about CALL_BYTES."""
        sizes_ = np.asarray([len(x) for x in texts], dtype=np.int64)
        return np.asarray([n for a, b in byte_batches(sizes_) for n in self._lengths(texts[a:b])], dtype=np.int64)

    def _by_word(self, parts: list[str]) -> np.ndarray:
        """Lengths of parts as the sums of their words'; a batch's distinct words are encoded once, known ones not at all."""
        words = pc.ascii_split_whitespace(pa.array(parts, pa.large_string()))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        n = list(map(self._new.get, distinct))
        missing = [i for i, x in enumerate(n) if x is None]
        for i in missing:
            n[i] = self._old.get(distinct[i])
        unknown = [i for i in missing if n[i] is None]
        for i, x in zip(unknown, self._batched([distinct[i] for i in unknown]).tolist(), strict=True):
            n[i] = x
        if len(self._new) + len(missing) > REMEMBERED:
            self._old, self._new = self._new, {}
        self._new.update((distinct[i], n[i]) for i in missing if len(distinct[i]) <= LONGEST)
        total = np.concatenate([[0], np.cumsum(np.asarray(n, dtype=np.int64)[np.asarray(coded.indices, dtype=np.int64)])])
        return np.diff(total[np.asarray(words.offsets, dtype=np.int64)])

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null is empty."""
        if not self.splits:
            return self._batched([x or "" for x in texts.to_pylist()])
        parts, owner = [], []
        for i, (text, n) in enumerate(zip(texts.to_pylist(), sizes(texts).tolist(), strict=True)):
            own = split_safely(text.encode()) if n > SPLIT_BYTES else [text or ""]
            parts += own
            owner += [i] * len(own)
        n = np.zeros(len(parts), dtype=np.int64)
        for a, b in byte_batches(np.asarray([len(x) for x in parts], dtype=np.int64), BATCH_BYTES):
            n[a:b] = self._by_word(parts[a:b])
        return np.bincount(owner, n, len(texts)).astype(np.int64)


def counter(path: str) -> Counter:
    """One for each file and worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Tokens of every whole text (doc_id, text): doc_id, n_bytes of UTF-8, n_tokens and over_limit (n_tokens > `limit`).

    No begin, end or added special tokens; the strings of special tokens inside a text are handled as the library does
    by default; nothing is truncated or padded. Each task counts what it reads in batches of equal bytes. For tokenizers
    whose tokens never reach over white space, texts beyond SPLIT_BYTES are cut at safe places, and a batch's distinct
    words are encoded in calls of about CALL_BYTES and remembered; others encode whole texts. The splits of a scan hold
    equal bytes, so nothing is shuffled; only numbers leave a task, and memory is bounded by one text.

    A null text is empty (0 bytes, 0 tokens), a null doc_id stays, repeated rows are counted each, other columns are
    ignored, and an empty table gives no rows.
    """
    path = tokenizer or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in pieces(batches, "text", BATCH_BYTES):
            n = count(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes(batch.column("text"))), pa.array(n), pa.array(n > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
