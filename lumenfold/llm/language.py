"""Language identification with a bit-sliced Bloom filter of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import mix, pieces, written

#: Characters of an n-gram, hash functions, least count and least share of the best language's frequency.
GRAM, PROBES, LEAST, SHARE = 3, 4, 3, 0.2
#: Slots for each n-gram, and the bounds of the whole filter.
SPARSE, SMALLEST, LARGEST = 16, 1 << 16, 1 << 22
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


@dataclass
class Grams:
    """n-grams of whole texts: each distinct one as a 63-bit key, and for each occurrence its text and distinct one."""

    keys: np.ndarray
    which: np.ndarray
    text: np.ndarray
    letters: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Grams:
        """Lower-cased texts; whatever is not a letter parts words, and an n-gram may begin or end at a word's end."""
        low = [(t or "").lower() for t in texts]
        raw = np.frombuffer(("\0\0".join(low) + "\0\0").encode("utf-32-le", "replace"), dtype=np.uint32)
        lengths = np.array([len(t) + 2 for t in low])
        owner = np.repeat(np.arange(len(low)), lengths)
        letter = _is_letter()[raw]
        code = np.where(letter, raw, 0)
        letters = np.bincount(owner[letter], minlength=len(low))
        keep = letter | np.concatenate([[False], letter[:-1]])  # letters and the first sign after a word
        code, owner = code[keep], owner[keep]
        alphabet = np.flatnonzero(np.bincount(code, minlength=1))
        place = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, dtype=np.int64)
        place[alphabet] = np.arange(len(alphabet))
        dense = place[code]
        size = max(1, len(alphabet))
        # the gap before a word is the one after the word before it; a text's first word has none
        a, b, c = dense[:-2], dense[1:-1], dense[2:]
        at = np.flatnonzero((owner[:-2] == owner[2:]) & (code[1:-1] != 0)) if len(code) > 2 else np.zeros(0, dtype=np.int64)
        own = (a[at] * size + b[at]) * size + c[at] if len(at) else at
        if size ** 3 <= 1 << 24:
            seen = np.flatnonzero(np.bincount(own, minlength=1))
            where = np.zeros(size ** 3, dtype=np.int64)
            where[seen] = np.arange(len(seen))
            which = where[own]
        else:
            seen, which = np.unique(own, return_inverse=True)
        letters_of = alphabet.astype(np.uint64) if len(alphabet) else np.zeros(1, dtype=np.uint64)
        keys = letters_of[seen // size ** 2] << np.uint64(42) | letters_of[seen // size % size] << np.uint64(21) | letters_of[seen % size]
        return cls(keys, which, owner[at], letters)


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    """The slots of each n-gram, one column for each hash function. size is a power of two."""
    first, second = mix(keys + np.uint64(1)), mix(keys ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return ((first[:, None] + second[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(size - 1)).astype(np.int64)


@dataclass
class LanguageFilter:
    """One slot table for each 32 languages; bit l of a slot is a Bloom filter's bit for language l."""

    languages: list[str]
    commonest: str | None
    planes: np.ndarray

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """Languages that contain each n-gram, as bits, by plane."""
        slots = _slots(keys, self.planes.shape[1])
        return np.bitwise_and.reduce(self.planes[:, slots], axis=2)

    def false_positives(self) -> np.ndarray:
        """Chance that an n-gram which a language lacks is found in it: the share of its slots that are set, per probe."""
        fill = [(self.planes[k // 32] >> np.uint32(k % 32) & 1).mean() for k in range(len(self.languages))]
        return np.asarray(fill) ** PROBES

    def predict(self, texts: list[str | None], false: np.ndarray) -> tuple[list[str], np.ndarray]:
        grams = Grams.of(texts)
        n, count = len(texts), len(self.languages)
        total = np.bincount(grams.text, minlength=n).astype(np.float64)
        hits = np.zeros((n, count))
        if count:
            masks = self.masks(grams.keys)
            kinds, kind = np.unique(masks, axis=1, return_inverse=True)
            kind = kind.ravel()[grams.which] if len(grams.which) else grams.which
            table = np.bincount(grams.text * kinds.shape[1] + kind, minlength=n * kinds.shape[1]).reshape(n, -1)
            bits = np.stack([kinds[k // 32] >> np.uint32(k % 32) & 1 for k in range(count)], axis=1)
            hits = table @ bits.astype(np.float64)
        real = np.maximum(hits - total[:, None] * false, 0) / np.maximum(1 - false, 1e-9)
        best = real.argmax(axis=1) if count else np.zeros(n, dtype=np.int64)
        value = real[np.arange(n), best] if count else np.zeros(n)
        names = []
        for i in range(n):
            if texts[i] is None or not grams.letters[i] or not count:
                names.append("und")
            else:
                names.append(self.languages[best[i]] if value[i] > 0 else self.commonest)
        known = np.array([x != "und" for x in names], dtype=bool)
        return names, np.where(known, np.clip(value / np.maximum(total, 1), 0, 1), 0.0)


def learn(docs: DataFrame) -> LanguageFilter:
    """Counts the n-grams of all texts with a language, and sets the bits of those that are typical of a language.

    A language contains an n-gram that occurs in it at least LEAST times and with at least SHARE of the frequency it
    has in the language where it is commonest; so a stray quotation does not mark it. Counts and slots are summed by
    Spark; the driver gets one row for each language and for each slot of a filter of bounded size.
    """
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            names, of = np.unique(np.asarray(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            texts = batch.column("text").to_pylist()
            for k, name in enumerate(names):
                own = np.flatnonzero(of == k)
                grams = Grams.of([texts[i] for i in own])
                n = np.bincount(grams.which, minlength=len(grams.keys))
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * (len(n) + 1)), pa.array(np.append(grams.keys.view(np.int64), -1)),
                                                  pa.array(np.append(n, len(own)))], ["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("gram") >= 0, F.col("n"))).alias("all"), F.max(F.when(F.col("gram") < 0, F.col("n"))).alias("docs"))
    per_language = sorted(totals.collect(), key=lambda r: r["lang"])  # one row for each language
    languages = [r["lang"] for r in per_language]
    if not languages:
        return LanguageFilter([], None, np.zeros((1, SMALLEST), dtype=np.uint32))
    commonest = min(per_language, key=lambda r: (-r["docs"], r["lang"]))["lang"]
    spark = docs.sparkSession
    index = spark.createDataFrame([(r["lang"], k, float(r["all"] or 1)) for k, r in enumerate(per_language)], "lang string, k int, total double")
    rated = counts.where(F.col("gram") >= 0).join(F.broadcast(index), "lang").withColumn("rate", F.col("n") / F.col("total"))
    grouped = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("k", "n", "rate")).alias("of"))
    typical = F.filter("of", lambda x: (x["n"] >= LEAST) & (x["rate"] >= SHARE * F.col("top")))
    marked = grouped.select("gram", F.explode(typical).alias("x")).select("gram", F.expr("x.k div 32").cast("int").alias("plane"), F.expr("shiftleft(1L, x.k % 32)").alias("bit"))
    marked = marked.groupBy("gram", "plane").agg(F.bit_or("bit").alias("bits"))
    distinct = marked.select("gram").distinct().count()
    size = min(LARGEST, max(SMALLEST, 1 << (SPARSE * max(distinct, 1) - 1).bit_length()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = _slots(np.asarray(batch.column("gram"), dtype=np.int64).view(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("plane")), PROBES)), pa.array(slots.ravel()),
                                              pa.array(np.repeat(np.asarray(batch.column("bits")), PROBES))], ["plane", "slot", "bits"])

    slots = marked.mapInArrow(spread, "plane int, slot long, bits long").groupBy("plane", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    planes = np.zeros((-(-len(languages) // 32), size), dtype=np.uint32)
    planes[np.asarray(slots.column("plane")), np.asarray(slots.column("slot"))] = np.asarray(slots.column("bits")).astype(np.uint32)
    return LanguageFilter(languages, commonest, planes)


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred and score.

    score is the share of the text's n-grams that the language contains, corrected for false positives. `und` (score 0)
    stands for null, texts without a letter, and all texts if nothing was learnt; a text with letters but no known
    n-gram gets the commonest language. Repeated rows give repeated rows; an empty table none; only the text is read.
    """
    false = model.false_positives() if model.languages else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            names, score = model.predict(batch.column("text").to_pylist(), false)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Learns from all but one fold of the documents and predicts all: doc_id, held_out, lang_pred, score.

    A document's fold is crc32 of its doc_id as text, modulo `folds`; rows without doc_id are held out.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = learn(docs.where(fold != held_out))
    return predict(docs, model).select("doc_id", F.coalesce(fold == held_out, F.lit(True)).alias("held_out"), "lang_pred", "score")
