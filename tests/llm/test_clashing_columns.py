"""The stages of the pipeline on documents whose extra columns have the names of helper columns, and on odd rows."""

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import cotrain, fmindex, packing, passages, simhash

HELPERS = ["_seen", "_Gone_ID", "_gone_text", "_gone_text_", "_cut_id", "_cut_text", "_cut_spans", "root", "key", "first", "text_hash", "rep", "score", "spans", "start"]
PASSAGE = " ".join(f"common{k}" for k in range(60))


@pytest.fixture
def odd(spark):
    rows = [(1, "alpha beta " + PASSAGE, "1"), (2, "gamma " + PASSAGE + " delta", "2"), (3, None, "0"), (4, "", "0"), (5, "same text here", "3"),
            (6, "same text here", "3"), (6, "same text here", "3"), (None, "no id", "4"), (7, "x " * 3000, "5")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    return d.select("*", *[F.lit(i).alias(n) for i, n in enumerate(HELPERS)])


def test_stages_keep_extra_columns(spark, odd):
    few = simhash.keep_one(odd)
    assert few.columns == odd.columns and sorted(r["doc_id"] or 0 for r in few.collect()) == [0, 1, 3, 5, 7]  # 1 and 2 are near, 3 and 4 both have no word
    cut = {r["doc_id"]: r for r in passages.remove_passages(odd.where("doc_id <> 6")).collect()}
    assert cut[2]["text"].split() == ["gamma", "delta"] and cut[2]["n_chars"] == str(len(cut[2]["text"])) and cut[1]["n_chars"] == "1"
    items = spark.createDataFrame([(1, " ".join(f"common{k}" for k in range(20, 40))), (2, None)], "item_id long, text string")
    for block in (1 << 24, 1):  # in one block, and in several
        good = fmindex.drop_contaminated(odd, items, block_bytes=block)
        assert good.columns == odd.columns and sorted(r["doc_id"] or 0 for r in good.collect()) == [0, 3, 4, 5, 6, 6, 7]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    kept = cotrain.keep_accepted(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= 9
    assert packing.pack_documents(odd).where("doc_id = 6").count() >= 2


def test_stages_on_no_rows(spark, odd):
    none = odd.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (simhash.keep_one(none), passages.remove_passages(none), fmindex.drop_contaminated(none, items), cotrain.keep_accepted(none, labels)):
        assert out.columns == odd.columns and out.count() == 0
