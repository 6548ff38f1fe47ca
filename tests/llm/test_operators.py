"""Each operator against a brute-force version or an exact round trip, and on rows that are odd."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lumenfold.llm import boilerplate, components, cotrain, fmindex, huffman, itq, language, packing, passages, quotes, simhash
from lumenfold.llm.common import ALNUM, Words
from lumenfold.llm.tokens import WordTokenizer, default_path

LONG = " ".join(f"word{k}" for k in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One."), (5, "same text here and there"), (6, "same text here and there"),
       (6, "same text here and there"), (None, "no id at all"), (7, LONG), (8, "Ünï ça ß ǅ 日本語 <|endoftext|> é"), (9, "x" * 5000)]


def reference_ids(text):
    from tokenizers import Tokenizer
    reference_ids.t = getattr(reference_ids, "t", None) or Tokenizer.from_file(default_path())
    return reference_ids.t.encode(text or "", add_special_tokens=False).ids


# ---- tokens, packing, token files -------------------------------------------

def test_word_by_word_ids_equal_whole_text_ids():
    texts = [t for _, t in ODD] + ["don't THE'LL it's.", "a b c d\x85e", "İstanbul ŉ Ǆ ﬁ", "1234 v2.0###", "a,b;c!!", "'s 's't", "ÉCOLE été ELLE'S"]
    ids, places = WordTokenizer(default_path()).encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[places[k]:places[k + 1]].tolist() == reference_ids(t), t


def check_packing(rows, got, capacity=4096, segments=64):
    want = sorted((-1 if i is None else i, tuple(reference_ids(t) + [2])) for i, t in rows)
    pieces = {}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts[:-1]]).tolist()
        total = sum(r["length"] for r in parts)
        assert total <= capacity and len(parts) <= segments and total & (total - 1) == 0
    for i in {i for i, _ in want}:
        docs_ = [x for k, x in want if k == i]
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, docs_))
        for r in pieces[i]:
            own = [np.asarray(x[r["start"]:r["start"] + r["length"]], "<u4").tobytes() for x in docs_]
            assert r["ids"] in own and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["doc_tokens"] in [len(x) for x in docs_]


def test_packing(docs):
    check_packing(ODD, packing.pack_documents(docs(ODD)).collect())
    small = packing.pack_documents(docs(ODD), capacity=256, segments=3).collect()
    check_packing(ODD, small, 256, 3)
    assert packing.pack_documents(docs([])).count() == 0


def test_packing_limits_loss_bearing_tokens():
    rng = random.Random(4)
    p = packing.VectorPacker(512, 8, 200)
    whole = {}
    for i in range(3000):
        n = rng.choice([1, 5, 40, 300, 900])
        whole[i] = (np.arange(n, dtype=np.uint32), rng.randint(0, n))
        p.add(i, *whole[i])
    p.close()
    seen, by_sequence = {}, {}
    for doc, start, length, _, _, seq, _, loss, _ in p.out:
        assert loss == max(0, start + length - max(start, whole[doc][1]))
        seen.setdefault(doc, []).append((start, length))
        s = by_sequence.setdefault(seq, [0, 0, 0])
        s[0], s[1], s[2] = s[0] + length, s[1] + 1, s[2] + loss
    assert all(a <= 512 and b <= 8 and c <= 200 for a, b, c in by_sequence.values())
    for doc, (ids, _) in whole.items():
        parts = sorted(seen[doc])
        assert [a for a, _ in parts] == np.cumsum([0] + [n for _, n in parts[:-1]]).tolist() and sum(n for _, n in parts) == len(ids)


def test_token_files_round_trip(spark, docs):
    folder = huffman.encode_corpus(docs(ODD), block=64, interval=8)
    got = huffman.read_corpus(spark, folder).orderBy("start").collect()
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = np.asarray(reference_ids(t) + [1], "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (i, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    assert huffman.read_corpus(spark, huffman.encode_corpus(docs([]))).count() == 0


@pytest.mark.parametrize("n,longest", [(1, 20), (2, 5), (33, 6), (5000, 13)])
def test_code_lengths_are_the_best_within_the_limit(n, longest):
    rng = np.random.default_rng(n)
    counts = np.floor(rng.pareto(0.5, n) + 1).astype(np.int64)
    counts = np.insert(counts, 0, 0)
    lengths = huffman.code_lengths(counts, longest)
    assert lengths[0] == 0 and lengths.max() <= longest and (n == 1 or (2.0 ** -lengths[1:]).sum() == 1)
    code = huffman.Code(lengths)
    ids = rng.choice(np.flatnonzero(counts), 3000)
    assert (code.decode(code.encode(ids, 7)) == ids).all() and len(code.decode(code.encode(ids[:0]))) == 0
    if n == 33:  # dynamic programming over sorted counts: least cost of complete trees of bounded depth
        from functools import lru_cache
        c = sorted(counts[1:].tolist(), reverse=True)

        @lru_cache(None)
        def best(i, nodes, depth):
            if i == len(c):
                return 0
            if nodes == 0 or depth > longest:
                return float("inf")
            return min(sum(c[i:i + k]) * depth + best(i + k, (nodes - k) * 2, depth + 1) for k in range(0, min(nodes, len(c) - i) + 1))

        assert (counts * lengths).sum() == best(0, 2, 1)


# ---- SimHash ----------------------------------------------------------------

def brute_simhash(rows):
    prints = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        bits = np.zeros(64, int)
        for x in s:
            h = xxhash.xxh64_intdigest(x.encode(), 42)
            bits += [h >> b & 1 for b in range(64)]
        prints.append(sum(1 << b for b in range(64) if 2 * bits[b] > len(s)))
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    names = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            names[c] = min(names.get(c, i), i)
    return sorted(((i is None, i or 0), f"{p:016x}", names.get(c)) for (i, _), p, c in zip(rows, prints, label, strict=True))


def test_simhash_against_brute_force(docs):
    rng = random.Random(2)
    base = [f"w{rng.randrange(50)}" for _ in range(120)]
    rows = list(ODD)
    for i in range(100, 160):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    for block in (8192, 3):
        got = simhash.components(docs(rows), block=block).collect()
        assert sorted(((r[0] is None, r[0] or 0), r[1], r[2]) for r in got) == brute_simhash(rows)
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    comps = {}
    for _, p, c in brute_simhash(rows):
        comps.setdefault(c, p)
    assert kept.count() == len(comps)
    assert simhash.components(docs([])).count() == 0


def test_four_equal_bytes_always_meet():
    from itertools import combinations
    sets = simhash.position_sets()
    assert len(sets) == 20 and all(any(set(s) <= set(q) for s in sets) for q in combinations(range(8), 4))


def test_components_of_long_chains_and_stars(spark):
    edges = [(k + 1, k) for k in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000), (1000, 1001)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1200), 1000)}


# ---- decontamination --------------------------------------------------------

def brute_hits(rows, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = {}
    for i, t in items:
        w = word.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = word.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append(((i is None, i or 0), len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_decontamination_against_brute_force(spark, docs):
    rng = random.Random(7)
    vocabulary = [f"W{k}é" if k % 3 else f"w{k}" for k in range(6)]
    rows = ODD + [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-x"]) for _ in range(rng.randrange(200)))) for i in range(20, 70)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 12, 13, 14, 20])]
    items += [(30 + k, rows[15 + k][1]) for k in range(5)] + [(99, None), (5, "w0 w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 24, 60):
        got = fmindex.report(fmindex.scan(docs(rows), bench, block_bytes=block)).collect()
        assert sorted(((r[0] is None, r[0] or 0), *tuple(r)[1:6]) for r in got) == brute_hits(rows, items)
        clean = sum(not x[5] for x in brute_hits(rows, items))
        left = fmindex.drop_contaminated(docs(rows), bench, block_bytes=block)
        assert left.count() == clean and left.columns == docs(rows).columns
    assert fmindex.report(fmindex.scan(docs(rows), bench.limit(0))).where("n_hit > 0").count() == 0
    assert fmindex.scan(docs([]), bench).count() == 0


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 5, 400)
    index = fmindex.FMIndex(text)
    for size in (1, 2, 5):
        phrases = rng.integers(1, 6, (50, size))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [k for k in range(len(text) - size + 1) if (text[k:k + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


# ---- passages ---------------------------------------------------------------

def test_compact_windows_follow_their_definition():
    rng = np.random.default_rng(1)
    hashed = passages.mix(rng.integers(0, 40, 300).astype(np.uint64))
    offsets = np.array([0, 0, 4, 90, 90, 300])
    value = hashed & ~passages._LOW
    want = set()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        for c in range(a, b):
            low = next((k + 1 for k in range(c - 1, a - 1, -1) if value[k] <= value[c]), a)
            high = next((k - 1 for k in range(c + 1, b) if value[k] < value[c]), b - 1)
            if high - low + 1 >= 10:
                want.add((low, c, high))
    assert set(zip(*(x.tolist() for x in passages.compact_windows(hashed, offsets, 10)), strict=True)) == want


def test_repeated_passages_are_found_and_cut(spark, docs):
    rng = random.Random(11)
    words = lambda n: [f"t{rng.randrange(10 ** 6)}" for _ in range(n)]
    shared, line = words(60), words(9)
    rows = [(i, t) for i, t in ODD if i != 7]
    for i in range(100, 120):
        rows.append((i, " ".join(words(80) + line + (shared if i % 2 else []) + words(40))))
    near = list(shared)
    near[30] = "CHANGED"
    gap = shared[:25] + ["inserted"] + shared[25:]
    rows += [(200, " ".join(words(10) + near + words(10))), (201, " ".join(words(10) + gap + words(10))), (202, rows[-1][1].upper())]
    found = passages.near_duplicate_passages(docs(rows)).collect()
    by_doc = {}
    for r in found:
        assert r["kept_doc_id"] < r["doc_id"] and r["similarity"] >= 0.8 and r["end"] - r["start"] >= 50
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    exact = set(range(103, 120, 2))
    assert set(by_doc) == exact | {200, 201, 202}
    assert all((80, 149) in by_doc[i] for i in exact)  # the phrase before it is shared as well
    assert by_doc[200] == [(10, 70)] and by_doc[201] == [(10, 71)]
    cut = {r["doc_id"]: r for r in passages.remove_passages(docs(rows)).collect() if r["doc_id"] is not None}
    texts = dict(rows)
    assert cut[101]["text"] == texts[101] and cut[100]["text"] == texts[100] and cut[202]["text"] == ""
    w = texts[103].split()
    assert cut[103]["text"].split() == w[:80] + w[149:] and cut[103]["n_chars"] == len(cut[103]["text"])
    assert passages.remove_passages(docs(rows)).count() == len(rows)
    assert passages.near_duplicate_passages(docs([])).count() == 0


def test_a_passage_that_many_documents_share_makes_one_row_for_each(spark, docs):
    from lumenfold.llm.passages import _star, _texts, _windows
    common = [f"common{k}" for k in range(400)]
    rows = [(i, " ".join([f"own{i}_{k}" for k in range(60)] + common)) for i in range(50)]
    links = _star(_windows(_texts(docs(rows).coalesce(1)), 5, 46, 4)).where("rep is not null").cache()
    size = {(r["doc"], r["rep"]): len(r["here"]) for r in links.collect()}
    assert len(size) == links.count() and all(size[i, 0] >= 20 for i in range(1, 50))


def test_a_common_phrase_in_the_first_document_hides_no_passage(docs):
    rng = random.Random(5)
    words = lambda n: [f"t{rng.randrange(10 ** 6)}" for _ in range(n)]
    lines = [words(9) for _ in range(6)]
    rows = [(k, " ".join(words(60) + lines[k] + words(60))) for k in range(6)]  # each phrase alone, in earlier documents
    shared = [w for x in lines for w in x]
    rows += [(10, " ".join(words(60) + shared + words(60))), (11, " ".join(words(70) + shared + words(60)))]
    found = passages.near_duplicate_passages(docs(rows)).collect()
    assert [(r["doc_id"], r["start"], r["end"], r["kept_doc_id"]) for r in found] == [(11, 70, 124, 10)]


def stock_phrases(one, other, words, least=46):
    """The 5 words of each window that two texts share, alone between other words, where it is a window as well."""

    def windows(text, seed):
        hashed, offsets = passages.shingles(Words(pa.array([" ".join(text)])))
        return {int(hashed[x]): int(x) for x in passages.compact_windows(passages.mix(hashed ^ seed), offsets, least)[1]}

    out = []
    for seed in passages._SEEDS[:passages.HASHES]:
        first, second = windows(one, seed), windows(other, seed)
        for value in first.keys() & second.keys():
            while True:
                text = words(60) + one[first[value]:first[value] + 5] + words(60)
                if value in windows(text, seed):
                    break
            out += text
    return out


def test_exact_copies_are_found_whatever_other_documents_hold_their_windows(docs):
    rng = random.Random(8)
    words = lambda n: [f"t{rng.randrange(10 ** 6)}" for _ in range(n)]
    shared, twice = words(50), words(50)
    # (a) the copies' windows are grouped in one task with another document's; (b) the first document has them twice
    one, three = words(60) + shared + words(60), words(70) + shared + words(60)
    eleven, twelve = words(60) + twice + words(60), words(80) + twice + words(60)
    before = stock_phrases(eleven, twelve, words)
    rows = {1: one, 2: stock_phrases(one, three, words), 3: three, 11: before + eleven, 12: twelve}
    table = docs([(k, " ".join(v)) for k, v in rows.items()])
    parts = table.where("doc_id in (2, 3, 12)").coalesce(1).union(table.where("doc_id in (1, 11)").coalesce(1))
    found = passages.near_duplicate_passages(parts).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["kept_doc_id"], r["kept_start"]) for r in found) == [
        (3, 70, 120, 1, 60), (12, 80, 130, 11, len(before) + 60)]


@pytest.mark.parametrize("edit", [9, 10, 14, 25])
@pytest.mark.parametrize("replaced", [False, True])
def test_long_edits_are_bridged_as_far_as_similarity_allows(edit, replaced):
    rng = np.random.default_rng(edit)
    fresh = iter(rng.permutation(1 << 20).astype(np.uint32))
    new = lambda n: np.array([next(fresh) for _ in range(n)], dtype=np.uint32)
    for half in range(30, 160, 5):
        one, two, gap = new(half), new(half), edit + 4
        a = np.concatenate([new(70), one, new(gap), two, new(70)])
        b = np.concatenate([new(80), one, new(gap if replaced else 4), two, new(80)])
        # brute force: all ends that are at run ends, as anything else is shorter or less similar
        skipped = (gap if replaced else 4) + gap
        whole = 2 * half / (2 * half + skipped) >= 0.8
        got = {p[:2] for p in passages.align(a, b, [70 + half // 2], [80 + half // 2], 46, 0.8)}
        want = {(70, 70 + 2 * half + gap)} if whole else {(70, 70 + half)} if half >= 46 else set()
        assert got == want, half


# ---- embeddings -------------------------------------------------------------

def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(6, 32))
    x = [list(map(float, centre[k % 6] + 0.08 * rng.normal(size=32))) for k in range(90)] + [list(map(float, rng.normal(size=32))) for _ in range(60)]
    rows = [(k, v, k % 2) for k, v in enumerate(x)] + [(200 + k, x[3], 1) for k in range(5)]
    odd = [(300, None, 1), (301, [0.0] * 32, 1), (302, [float("nan")] * 32, 1), (303, [None] * 32, 1), (304, x[3], None), (305, [1.0, 0.0], 1), (306, [2.0, 0.0], 1),
           (307, [], 1), (None, x[3], 1), (308, [v * 1e200 for v in x[3]], 1)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    want = {}
    usable = [r for r in rows + odd if r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    unit = {r[0]: np.asarray(r[1]) / np.abs(r[1]).max() for r in usable}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    label = {r[0]: r[2] for r in usable}
    links = {a: {b for b in unit if b != a and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93} for a in unit}
    comp = {a: a for a in unit}
    for _ in unit:
        comp = {a: min([comp[a], *(comp[b] for b in links[a])]) for a in unit}
    for block in (1024, 4):
        got = {r["vec_id"]: tuple(r)[1:] for r in itq.near_duplicates(d, block=block).collect()}
        assert len(got) == len(rows + odd)
        missed = 0
        for r in rows + odd:
            n, c = (len(links[r[0]]), comp[r[0]]) if r[0] in unit else (0, r[0])
            missed += n - got[r[0]][0]
            assert got[r[0]][0] <= n and (got[r[0]][0] < n or got[r[0]][1:] == (c, c == r[0]))
        assert missed <= 0.1 * sum(map(len, links.values()))
    assert itq.near_duplicates(d.limit(0)).count() == 0


# ---- language, quality ------------------------------------------------------

def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    parts = {"aa": ["tha", "ing", "and", "ent"], "bb": ["ment", "eau", "ois", "que"], "cc": ["ung", "sch", "keit", "ein"]}
    make = lambda k: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randrange(1, 4))) for _ in range(40))
    rows = [(i, make(k), k) for i in range(300) for k in [("aa", "bb", "cc")[i % 3]]]
    odd = [(900, None, "aa"), (901, "123 !?", "bb"), (902, "日本", None), (903, "", "cc"), (None, make("bb"), "bb"), (904, "y", None)]
    d = spark.createDataFrame([(*r, "x", 1.0) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r["doc_id"]: r for r in language.identify(d).collect()}
    assert len(got) == len(rows + odd)
    assert all(got[i]["lang_pred"] == k for i, _, k in rows) and got[None]["lang_pred"] == "bb" and got[None]["held_out"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1 for i in got if i is not None)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 903)) and got[902]["lang_pred"] in parts
    assert {r["lang_pred"] for r in language.identify(d.limit(0).union(d.where("lang is null"))).collect()} == {"und"}


def test_more_languages_than_bits_in_a_plane(spark):
    rows = [(i, (chr(0x4E00 + 40 * (i % 40)) + chr(0x4E01 + 40 * (i % 40)) + chr(0x4E02 + 40 * (i % 40)) + " ") * 5, f"l{i % 40:02}") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(d)
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 40:02}" for r in language.predict(d, model).collect())


def test_quality_rejects_what_labels_call_bad(spark, docs):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(60)) + "."
    rows, labels = [], []
    for i in range(600):
        kind = i % 6
        text = good()
        if kind == 0:
            text = " | ".join(text.split())
        elif kind == 1:
            text += " you idiot clown"
        rows.append((i, text))
        if i % 2 == 0 or i < 300:
            labels.append((i, int(kind != 0), int(kind == 1)))
    lab = spark.createDataFrame(labels + [(None, 1, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    d = docs(rows + [(None, None), (9999, ""), (10_000, LONG)])
    got = {r["doc_id"]: r for r in cotrain.score_documents(d, lab).collect()}
    assert len(got) == len(rows) + 3
    right = [got[i]["accepted"] == (i % 6 > 1) for i in range(600)]
    assert np.mean(right) > 0.98
    kept = cotrain.keep_accepted(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r["accepted"] for r in got.values())
    assert cotrain.score_documents(d, lab.limit(0)).where("accepted").count() == len(got)
    assert cotrain.score_documents(docs([]), lab).count() == 0


# ---- quotations -------------------------------------------------------------

def test_quotations_are_linked_and_removed(spark):
    m = [(1, 0, "u", "Hello there.\n\nHow is the   weather?"), (1, 1, "a", "> how is THE weather?\n\nFine."),
         (1, 2, "u", "On Monday Bob wrote:\n>> How is the weather?\n> Fine.\n\nGood to know."), (1, 3, "u", "Another thread"),
         (1, 4, "u", "> Good to know.\nYes"), (1, 5, "a", "> Another thread\nok"), (1, 6, "a", "> unknown words\nhm"),
         (None, 0, "u", "> x"), (2, None, "u", None), (2, 0, "u", "x"), (2, 0, "u", "x"), (2, 1, "a", ">>>"), (3, 0, "a", "> Fine.")]
    d = spark.createDataFrame([(*r, 1) for r in m], "conv_id long, turn long, role string, text string, position int")
    got = quotes.link_quotations(d).collect()
    one = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert {t: r["parent_turn"] for t, r in one.items()} == {0: None, 1: 0, 2: 1, 3: None, 4: 2, 5: 3, 6: None}
    assert sorted(one, key=lambda t: one[t]["position"]) == [0, 1, 2, 4, 3, 5, 6]
    assert one[4]["depth"] == 3 and one[4]["root_turn"] == 0 and one[2]["max_level"] == 2 and one[2]["n_linked"] == 2
    assert all(">" not in r["text"] and "wrote" not in r["text"] for r in got) and len(got) == len(m)
    assert [r["parent_turn"] for r in got if r["conv_id"] != 1] == [None] * 6
    assert quotes.link_quotations(d.limit(0)).count() == 0


def test_long_reply_chains(spark):
    rows = [(7, k, "u", (f"> note {k - 1}\n" if k else "") + f"note {k}") for k in range(70)]
    got = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r["depth"] == r["turn"] == r["position"] and r["root_turn"] == 0 for r in got)


# ---- main text --------------------------------------------------------------

STRUCTURES = [
    ("<body><div id='menu'>x y</div><p>Hello&nbsp;<b>big</b>\n world &amp; co<p>two<br>lines</body>", "Hello big world & co\n\ntwo lines"),
    ("<article><header><h1>T</h1></header><p>a<div class='comments'><p>nope</div><p>b</article><footer>z</footer>", "T\n\na\n\nb"),
    ("<nav>n</nav><article><p>a &lt;b&gt; &#233;&hellip;</p><script>var t='</p>';</script><!-- c --><form>f</form></article><aside>s</aside>", "a <b> é…"),
    ("a < b and <i>c", "a < b and c"), ("", ""), (None, ""), ("<script>x</script", ""), ("<main>m<style>p{}</style></main>t", "m"),
    ("<p>1<nav>n<p>2</nav>3", "1\n\n3"), ("<div class=\"cookie-notice\">c</div><div class='adventure'>kept</div>", "kept"),
    ("<div class='page-with-sidebar'><article><p>A</p></article></div>", "A"), ("<form id=f><article>A<form>x</form></article></form>", "A"),
    ("<div class='sidebar'><article>only this one</article></div><p>b", "only this one"),
    ("<div class='related'><article>teaser</article></div><article>A</article>", "A"),
    ("<p>the text<div class='comments'><article>I, a reader, say much more than the text</article></div>", "the text"),
    ("<p>t<div><article class='comment odd'>reader, reader, reader</article></div>", "t"),
    ("<article><p class='share-price'>1<p class='search-results-text'>2<p id='related-work'>3<div class='post-header'><h1>4</h1></div>"
     "<div class='share-buttons'>x</div><div class='ad'>x</div><p>x<sup>2</sup> <math><mi>y</mi><mo>=</mo><mn>1</mn></math></article>", "1\n\n2\n\n3\n\n4\n\nx2 y=1"),
    ("<p class=\"a>text one</p>", "text one"), ("<p class=\"a>text</p><p id=\"b\">two</p>", "text\n\ntwo"), ("<p title='it's'>text", "text"),
    ("<p title=\"a > b\" data-x='<i>'>text", "text"), ("<a b=\"c", ""), ("<p class=\"x>t" * 3000, "\n\n".join(["t"] * 3000)),
]


def test_structure_of_pages(spark):
    rows = [(i, f"http://h{i}/", page, "x") for i, (page, _) in enumerate(STRUCTURES)]
    got = boilerplate.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in got} == {i: (want, len(want)) for i, (_, want) in enumerate(STRUCTURES)}


def test_repetition_on_a_host_is_boilerplate(spark):
    rows = [(i, f"http://H.org:80/{i}", f"<div>home about contact us today now please</div><div>{' '.join(f'w{i}_{k}' for k in range(30))}</div>") for i in range(5)]
    rows += [(9, "http://other.org", "<p>home about contact us today now please"), (4, rows[4][1], rows[4][2]), (10, None, None)]
    for shard in (256, 3):  # whole blocks are counted over the host, however its pages are dealt
        got = boilerplate.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard=shard).collect()
        assert len(got) == len(rows)
        assert [r["text"] for r in got if r["page_id"] == 9] == ["home about contact us today now please"]
        assert all("home" not in r["text"] and "_29" in r["text"] for r in got if r["page_id"] < 9)
    assert boilerplate.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repetition_on_a_host_of_600_pages_against_brute_force(spark):
    rng = np.random.default_rng(5)
    stock = [" ".join(f"s{k}x{j}" for j in range(8)) for k in range(40)]
    line = "subscribe to our letter and read more each week"
    pages, want_blocks = {}, {}
    for i in range(600):
        article = i % 3 == 0
        own = [" ".join(f"w{i}_{j}_{k}" for k in range(10)) for j in range(2)]
        picked = [stock[0]] if article and i % 2 else [stock[int(k)] for k in rng.choice(40, 2 if i % 50 else 3, replace=False)] if not article else []
        parts = [*own, *picked, *([line] if article else [])]
        rng.shuffle(parts)
        pages[i], want_blocks[i] = (article, parts), parts
    pages[600], pages[601] = (False, ["near copy one " + "a b c d e f g h " * 3]), (False, ["near copy two " + "a b c d e f g h " * 3])
    has = {}
    for article, parts in pages.values():
        for t in set(parts):
            has[article, t] = has.get((article, t), 0) + 1
    articles = sum(a for a, _ in pages.values())

    def boiler(article, t):
        n = has[article, t]
        return n >= max(20, 0.8 * articles) if article else n >= 3

    want = {i: "\n\n".join(" ".join(t.split()) for t in parts if not boiler(a, t)) for i, (a, parts) in pages.items()}
    assert any(line in " ".join(parts) for _, parts in pages.values()) and not any(line in t for t in want.values())
    assert any(stock[0] in t for t in want.values()) and want[600] and want[601]  # half of the articles have that block: it stays there
    rows = [(i, "http://one.org/", ("<article>%s</article>" if a else "<body>%s</body>") % "".join(f"<p>{t}</p>" for t in parts)) for i, (a, parts) in pages.items()]
    rows += [(700, *rows[1][1:])] * 50  # copies count as one page, repeated rows are dealt out and come back as often
    want[700] = want[1]
    for shard in (1000, 60):
        got = boilerplate.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard=shard).collect()
        assert len(got) == len(rows) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def test_pages_that_most_of_a_host_copies_keep_their_text(spark):
    rows = [(i, "http://h/", f"<p>menu of this small site for all</p><p>{'the same long report in ten words again ' * 4}{i}</p>") for i in range(6)]
    rows += [(10 + i, "http://h/", f"<p>menu of this small site for all</p><p>{' '.join(f'u{i}_{k}' for k in range(12))}</p>") for i in range(8)]
    got = boilerplate.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("menu" not in r["text"] and r["text"] for r in got) and all("report" in r["text"] for r in got if r["page_id"] < 6)


def test_repeated_tokens_against_brute_force():
    rng = np.random.default_rng(2)
    words, page = rng.integers(0, 3, 300).astype(np.uint64), np.repeat(np.arange(6), 50)
    want = np.zeros(300, bool)
    for a in range(295):
        for b in range(295):
            if page[a] != page[b] and page[a] == page[a + 5] and page[b] == page[b + 5] and (words[a:a + 6] == words[b:b + 6]).all():
                want[a:a + 6] = True
    assert (boilerplate.repeated(words, page, 6) == want).all()
    runs = {}
    for a in range(295):
        if page[a] == page[a + 5]:
            runs.setdefault(tuple(words[a:a + 6]), set()).add(page[a])
    most = [max([len(runs[tuple(words[a:a + 6])]) for a in range(max(0, i - 5), min(i, 294) + 1) if page[a] == page[a + 5]], default=0) for i in range(300)]
    assert boilerplate.occurrences(words, page, 6).tolist() == most


def test_words_of_a_batch():
    texts = ["Ab c", None, "", "  xéY-1 ", "ab C"]
    w = Words(pa.array(texts, pa.string()), ALNUM)
    assert np.diff(w.docs).tolist() == [2, 0, 0, 2, 2]
    assert (w.hashes[:2] == w.hashes[4:]).all() and w.raw[w.starts[2]:w.ends[2]].tobytes().decode() == "xéY"


def test_substrings_of_a_large_host_do_not_depend_on_how_its_pages_are_dealt(spark):
    rng = np.random.default_rng(8)
    tall = [" ".join(f"t{k}x{j}" for j in range(9)) for k in range(90)]  # each stands inside blocks of few pages, with other words around it
    footer, rare = "all rights of this site are kept by its owners", "some articles end with this line but most do not"
    for kinds in ((False, True), (False,), (True,)):
        rows = []
        for i in range(240):
            article = kinds[i % len(kinds)]
            parts = [" ".join(f"w{i}_{j}_{k}" for k in range(9)) for j in range(2)]
            parts += [f"p{i} {tall[int(k)]} q{i}" for k in rng.choice(90, 1, replace=False)]
            parts += [f"{footer} {i}"] * (i % 10 > 0) + [f"{rare} {i}"] * (i % 10 > 2)
            body = "".join(f"<p>{t}</p>" for t in parts)
            rows.append((i, "http://one.org/", f"<article>{body}</article>" if article else f"<body>{body}</body>"))
        rows += [(300 + k, *rows[5][1:]) for k in range(40)] + [(400, "http://two.org/", rows[0][2])]
        table = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = [{r["page_id"]: r["text"] for r in boilerplate.extract(table, shard=shard).collect()} for shard in (1000, 12)]
        assert got[0] == got[1] and len(got[0]) == len(rows)  # one suffix array over the host, and 24 groups of it
        assert all((footer in t) == (i == 400 and footer in rows[0][2]) for i, t in got[1].items())
        if kinds == (False,):
            assert any("t5x" in html and "t5x" not in got[1][i] for i, _, html in rows)
        if True in kinds:
            assert all(rare in got[1][i] for i, _, html in rows if "<article>" in html and rare in html) == (kinds == (True,))


def test_lists_of_windows_and_links(spark):
    at = np.arange(5, dtype=np.int64)
    rows = passages._open_rows(at, at, at)
    assert all(rows.column(c).null_count == 0 for c in ("kinds", "here", "there")) and rows.column("rep").null_count == 5
    links = spark.createDataFrame([(1, [7 << 32 | 2, 8 << 32 | 2, 9 << 32]), (1, [8 << 32 | 3]), (2, [5 << 32]), (3, [])], "doc long, here array<long>")
    assert {r["doc"]: sorted(r["f"]) for r in passages._far(links).collect()} == {1: [7, 8]}
    assert "explode" not in passages._far(links)._jdf.queryExecution().executedPlan().toString()


def test_chains_of_few_and_of_many_runs(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(60):
        a = rng.integers(0, 60, 80).astype("<u4")
        b = np.delete(np.where(rng.random(80) < 0.1, 99, a), rng.integers(0, 80, 3)).astype("<u4")
        one = passages._stops(a, b, 0.8, 80)
        with monkeypatch.context() as m:
            m.setattr(passages, "FEW_RUNS", 0)
            assert passages._stops(a, b, 0.8, 80).tolist() == one.tolist()


def test_an_insertion_that_leaves_a_similarity_of_exactly_four_fifths_is_bridged():
    b = np.arange(92, dtype=np.uint32)
    a = np.concatenate([b[:46], np.arange(1000, 1023, dtype=np.uint32), b[46:]])
    for here, there in ((20, 20), (100, 77)):
        assert passages.align(a, b, [here], [there], 46, 0.8) == [(0, 115, 0, 92, 0.8)]
        assert passages._passages(a, b, np.array([here]), np.array([there]), 46, 0.8)[0] == [(0, 115, 0, 92, 0.8)]


def test_sequences_that_are_joined_once_give_the_passages_of_each_place_alone():
    rng = np.random.default_rng(7)
    joined = 0
    for k in range(300):
        kinds = 40 if k % 5 == 0 else 1 << 20  # few kinds: b repeats values, and is aligned place by place
        b = rng.integers(0, kinds, 300).astype(np.uint32)
        a = np.concatenate([rng.integers(0, 1 << 20, 60), b[30:250], rng.integers(0, 1 << 20, 60)]).astype(np.uint32)
        for x in rng.integers(0, 300, int(rng.integers(0, 30))):
            a = np.delete(a, x) if x % 3 == 0 else np.insert(a, x, 1 << 21) if x % 3 == 1 else np.where(np.arange(len(a)) == x, 1 << 22, a)
        a = a.astype(np.uint32)
        shared = [(x, y) for x, v in enumerate(a.tolist()) for y in np.flatnonzero(b == v).tolist()]
        here, there = np.array([shared[i] for i in rng.integers(0, len(shared), 12)] + [(0, 0), (len(a), 5)]).T
        found = passages.align(a, b, here.tolist(), there.tolist(), 46, 0.8)
        open_ = passages._unsettled(a, b, here.tolist(), there.tolist(), 46, [p[:2] for p in found])
        one, rest = passages._passages(a, b, here, there, 46, 0.8)
        assert (one, rest.tolist()) == (found, open_.tolist())
        joined += passages.join(a, b) is not None
    assert 100 < joined < 300
