"""The pipeline's stages on the smallest tables, each judged on its own input."""

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import brute_hits, brute_simhash, check_packing

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "pack"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    names = [n.split("_")[0] for n in entry.queries()]
    assert all(names.count(f"op{k}") == 1 for k in range(1, 14))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.written(stage(spark, steps[-1], SF), "stage"))
    rows = [[(r["doc_id"], r["text"]) for r in s.select("doc_id", "text").collect()] for s in steps[:-1]]
    assert all(s.columns == docs.columns for s in steps[:-1])

    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = {i for i, _ in rows[0] if i in labels and labels[i]["quality"] == 1 and labels[i]["toxic"] == 0}
    kept = {i for i, _ in rows[1]}
    assert len(clean & kept) >= 0.95 * len(clean) and len(kept) <= len(rows[0])  # 87 labels are too few to reject much

    first = {}
    for (_, i), _, c in brute_simhash(rows[1]):
        first.setdefault(c, []).append(i)
    assert sorted(i for i, _ in rows[2]) == sorted(map(min, first.values()))

    assert sorted(i for i, _ in rows[3]) == sorted(i for i, _ in rows[2])
    seen, before = set(), dict(rows[2])
    for i, t in sorted(rows[3]):
        words = (t or "").encode().lower().split()
        own = {tuple(words[k:k + 50]) for k in range(len(words) - 49)}
        assert not own & seen and len(t) <= len(before[i])
        seen |= own

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = sorted(k[1] for k, *_, bad in brute_hits(rows[3], items) if not bad)
    assert sorted(i for i, _ in rows[4]) == good
    check_packing(rows[4], steps[-1].collect())
    assert corpus_pipeline.run(spark, SF).count() == steps[-1].count()
