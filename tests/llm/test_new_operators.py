"""Resampling, token counts and hard negatives against brute force, and on odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import lengths, negatives, resampling
from lumenfold.llm.tokens import default_path
from tests.llm.test_operators import LONG, ODD, reference_ids

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---- token counts -----------------------------------------------------------

def test_token_counts(docs):
    rows = ODD + [(20, "a\x0bb\x0cc\x1cd\x85e f"), (21, "<|ENDOFTEXT|> x<|startoftext|>y"), (22, "'s 't don't İstanbul ﬁ é ́x")]
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in lengths.count_tokens(docs(rows), limit=10).collect())
    want = [(-1 if i is None else i, len((t or "").encode()), len(reference_ids(t)), len(reference_ids(t)) > 10) for i, t in rows]
    assert got == sorted(want)
    assert lengths.count_tokens(docs([])).count() == 0


def test_long_texts_are_cut_where_no_token_reaches_across(monkeypatch):
    texts = [LONG, "12 34" * 900 + "a" * 10, "a1" * 3000, "x" * 9000, "é<|endoftext|>1'll " * 400, "日本語" * 3000, "1'2" * 2000]
    for t in texts:
        parts = lengths.split_safely(t.encode(), 500)
        assert "".join(parts) == t and sum(len(reference_ids(p)) for p in parts) == len(reference_ids(t))
    assert len(lengths.split_safely(LONG.encode(), 500)) > 400 and len(lengths.split_safely(b"x" * 9000, 500)) == 1
    monkeypatch.setattr(lengths, "SPLIT_BYTES", 500)
    monkeypatch.setattr(lengths, "REMEMBERED", 50)
    count = lengths.Counter(default_path())
    assert count.splits and count.count(pa.array([None, *texts])).tolist() == [0] + [len(reference_ids(t)) for t in texts]
    assert list(lengths.byte_batches(np.array([5, 5, 30, 1, 1]), 10)) == [(0, 2), (2, 3), (3, 5)]


def test_other_tokenizers_take_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    count, t = lengths.Counter(path), Tokenizer.from_file(path)
    texts = ["two  spaces", " lead", "", LONG[:3000]]
    assert not count.splits
    assert count.count(pa.array(texts)).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    model = lengths.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert model.count(pa.array(["a b", None])).tolist()[1] == 0


# ---- resampling -------------------------------------------------------------

def brute_resample(rows, target, percent=10, least=20, n_max=1, buckets=10_000):
    def found(text):
        w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode())
        return [zlib.crc32(b" ".join(w[k:k + n])) % buckets for n in range(1, n_max + 1) for k in range(len(w) - n + 1)], len(w)

    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for b in found(x)[0]:
                counts[b] += 1
    out = []
    for k, (i, x) in enumerate(rows):
        f, n = found(x)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in f]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, n >= least, k])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[5]))
    rank = {x[5]: k + 1 for k, x in enumerate(able[:len(able) * percent // 100])}
    return sorted((-1 if x[0] is None else x[0], x[1], x[2], x[3], rank.get(x[5], 0)) for x in out)


def collected(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"] or 0) for r in df.collect())


@pytest.mark.parametrize("n_max", [1, 2])
def test_resampling(spark, docs, n_max):
    rng = np.random.default_rng(6)
    rows = ODD + [(100 + k, " ".join(rng.choice(["Alpha", "beta-gamma", "ÜBER", "x7", "日本", "rare" + str(k % 5)], rng.integers(1, 60)))) for k in range(300)]
    target = ["alpha alpha x7", None, "", "beta x7 über"]
    t = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    got = collected(resampling.resample(docs(rows), t, percent=30, n_max=n_max))
    assert got == brute_resample(rows, target, 30, n_max=n_max)
    assert sum(r[4] > 0 for r in got) >= 50


def test_resampling_edges(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs([]), empty).count() == 0
    few = docs([(1, "one two"), (2, None)])
    assert [r["rank"] for r in resampling.resample(few, empty, percent=50).collect()] == [None, None]
    everything = [(k % 7, "same words " * 15) for k in range(50)]  # ties and repeated rows
    t = spark.createDataFrame([(1, "words")], "item_id long, text string")
    for percent in (1, 2, 50, 100):
        got = resampling.resample(docs(everything), t, percent=percent).collect()
        ranks = sorted(r["rank"] for r in got if r["rank"])
        assert ranks == list(range(1, 50 * percent // 100 + 1))
        top = sorted(((-r["score"], r["doc_id"]) for r in got))[:len(ranks)]
        assert sorted((-r["score"], r["doc_id"]) for r in got if r["rank"]) == top


def test_cutoff_bracket_is_widened(spark):
    n = 20_000
    rows = spark.range(n).select((F.pmod(F.col("id") * 7919, F.lit(n)) % 5000).alias("score"))
    scores = sorted((k % 5000 for k in range(n)), reverse=True)
    for wanted in (1, 2, 777, 10_000, n):
        for accuracy in (10, 10_000):
            assert resampling.locate_cutoff(rows, wanted, n, accuracy) == scores[wanted - 1]


# ---- hard negatives ---------------------------------------------------------

def brute_negatives(rows, every=100, low=30, high=90):
    seen = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        seen[i] = min(seen.get(i, own), own)
    out = []
    for a, (label, v) in seen.items():
        if a % every:
            continue
        others = sorted((-sum(p * q for p, q in zip(v, w)), i, k) for i, (k, w) in seen.items() if i != a and len(w) == len(v))
        for s, i, _ in [x for x in others if x[2] == label][:5]:
            near = [x for x in others if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:10]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(near)]
    return sorted(out)


def vectors(spark, rows):
    full = [(i, v, label, "x", 3) for i, v, label in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, anchor_id string, shard int")


def mined(df, **how):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in negatives.mine(df, **how).collect())


def test_hard_negatives(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 12))
    rows = []
    for k in range(900):
        label = int(rng.integers(0, 10))
        rows.append((k, [float(np.float32(x)) for x in centres[label] + centres[0] + 0.7 * rng.normal(size=12)], label))
    rows += [(1000 + k, rows[0][1], k % 3) for k in range(300)]  # one very common vector
    rows += [(2000, None, 1), (2100, [1.0] * 11 + [None], 1), (2200, [float("nan")] * 12, 1), (2300, [float("inf")] * 12, 1), (2400, [0.0] * 12, 1),
             (None, [1.0] * 12, 1), (2500, [1.0] * 12, None), (2600, [1.0, 2.0], 1), (2601, [1.0, 2.5], 1), (2602, [0.5, 1.0], 2), (2700, [], 3),
             (300, [2.0] * 12, 5), (300, [2.0] * 12, 5), (2800, [-1.0] * 12, 4), (2801, [-1.0] * 12, 4)]
    want = brute_negatives(rows)
    assert len(want) > 300
    d = vectors(spark, rows)
    assert mined(d) == want
    assert mined(d.repartition(7), shard=100, slice_=2) == want  # many shards and slices
    assert mined(vectors(spark, [])) == [] and mined(vectors(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []


def test_threshold_stops_early_and_loses_nothing():
    rng = np.random.default_rng(9)
    n = 4000
    v = np.floor(40 * rng.standard_normal((n, 3)) ** 3).astype(np.int64)  # few long vectors decide
    lists = negatives.SortedLists(np.arange(n), rng.integers(0, 2, n), v)
    read = []
    for a in range(0, n, 400):
        own = lists.search(v[a], lambda rows, scores, threshold: read.append(len(rows)) or np.count_nonzero(scores > threshold) >= 5)
        scores = v @ v[a]
        at = lists.best(*own, 5)
        assert own[0][at].tolist() == np.lexsort((np.arange(n), -scores))[:5].tolist()
    assert min(read) < n / 4


def test_scores_stay_exact_beyond_double_precision():
    big = np.array([[1 << 30, 3], [1 << 30, 2], [1 << 31, 1], [1 << 62, 1]], dtype=np.int64)
    lists = negatives.SortedLists(np.arange(4), np.zeros(4, int), big)
    rows, scores = lists.search(big[0], lambda *_: False)
    assert dict(zip(rows.tolist(), scores.tolist())) == {0: (1 << 60) + 9, 1: (1 << 60) + 6, 2: (1 << 61) + 3, 3: (1 << 63) - 1}
