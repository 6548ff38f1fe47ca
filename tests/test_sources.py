import json

import pytest
from pyspark.sql import functions as F

from lumenfold import schemas
from lumenfold.operators.points import materialise
from lumenfold.operators.quality import gate_files
from lumenfold.sources import settings, sinks, tables, text


def lines(spark, *texts):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "file int, text string")
    return materialise(d, lines=text.lines_of(F.col("text")))


def test_parser_order_and_rejection(spark):
    deep = "C1s,,,O1s,\n,1,2,,1\n" + "\n".join(f"{280 + k},{k},{k + 1},{530 + k},{k}" for k in range(4))
    table = "C1s,a,O1s,a\n" + "\n".join(f"{280 + k},{k + 20},{530 + k},{k + 5}" for k in range(4))
    paired = "C1s\n280,281,282,283\n5,6,7,8"
    jumps = "C1s\n280,290,282,283\n5,6,7,8"
    section = "C1s\nmeta\n280 1\n281 2\n282 3\nend"
    two = "# c\n280;1\n281;2"
    got = text.parse_files(lines(spark, deep, table, paired, jumps, section, two, "nothing here", "")).orderBy("file").collect()
    assert [r["parser"] for r in got][:3] == ["depth_table", "region_table", "paired_rows"]
    assert [r["parser"] for r in got][4:] == ["sections", "two_column", None, None]
    assert got[3]["parser"] != "paired_rows"
    assert {(p["region"], p["layer"]) for p in got[0]["points"]} == {("C1s", 1), ("C1s", 2), ("O1s", 1)}


def test_low_rows_dropped_in_table(spark):
    t = "C1s,a,a,O1s,a\n1,2,3,530,5\n280,20,30,531,6\n281,x,40,532,\n282,1,3,533,8\n283,2,4,534,9"
    p = text.parse_region_table(lines(spark, t)).first()["points"]
    assert [(r["energy"], r["intensity"]) for r in p if r["region"] == "C1s"] == [(280, 25), (281, 40), (282, 2), (283, 3)]
    assert [r["energy"] for r in p if r["region"] == "O1s"] == [530, 531, 533, 534]


def test_map_without_axis_uses_region_range(spark):
    m = text.parse_maps(lines(spark, "O 1s\n0 1 2\n0 1 2\n1 2 3\n4 5 6\n7 8 9\n1 2"))
    r = m.first()
    assert r["region"] == "O1s" and r["energy"] == [525.0, 532.5, 540.0] and (r["nx"], r["ny"]) == (2, 2) and len(r["rows"]) == 3
    px = text.map_pixels_of(m).orderBy("y", "x").collect()
    assert [p["intensity"] for p in px] == [[1, 2, 3], [4, 5, 6], [7, 8, 9], [0, 0, 0]]


def test_triage_needs_two_cycles(spark):
    one = "C1s depth profile\n" + "\n".join(f"{280 + k},{k}" for k in range(20))
    two = "C1s depth profile\n" + "\n".join(f"{280 + k},{k},{k}" for k in range(20))
    grid = "C1s\n0\n1\n3\n0\n1\n3\n" + ",".join(str(280 + k) for k in range(10)) + "\n" + "\n".join(",".join(["5"] * 10) for _ in range(9))
    d = lines(spark, one, two, grid, "x").withColumn("extension", F.lit("csv"))
    got = {r["file"]: (r["data_type"], r["route"]) for r in text.triage(d).collect()}
    assert got == {0: ("standard", "standard"), 1: ("depth_profile", "standard"), 2: ("map_hyperspectral", "map"), 3: ("unknown", "inspect")}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_text("280,1\n281,2\n")
    (tmp_path / "in" / "sub" / "b.csv").write_text("")
    (tmp_path / "in" / "sub" / "c.zip").write_bytes(b"\0" * 200)
    assert text.read_files(spark, [str(tmp_path / "in")], "*.csv").count() == 2
    with pytest.raises(ValueError):
        text.read_files(spark, [])
    found = text.read_headers(spark, str(tmp_path / "in"))
    expected = found.select("path").unionByName(spark.createDataFrame([(f"file:{tmp_path}/in/sub/b.csv",)], "path string"))
    g = {r["path"][-5:]: r for r in gate_files(text.with_expected(found, expected)).collect()}
    cats = {k: sorted(i["category"] for i in r["issues"]) for k, r in g.items()}
    assert cats == {"a.csv": ["file_size"], "b.csv": ["file_access"], "c.zip": ["file_corruption", "file_format"]}
    assert not any(r["accepted"] for r in g.values())


def test_sinks(spark, tmp_path):
    pts = spark.createDataFrame([("s1", "C1s", k, 280.0 + k / 3, float(k)) for k in range(5)],
                                "spectrum_id string, region string, i int, energy double, intensity double")
    sinks.write_spectra_csv(pts, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 5 and back.filter("region = 'C1s'").count() == 5
    fit = spark.createDataFrame([("f", "s", None, "C1s", "x", 284.81234, 1.2, 0.3, 10.0, 5.0, 50.06, 0.99, "t")], schemas.FIT_RESULT)
    sinks.write_fit_results(fit, str(tmp_path / "fit"), "20240101000000")
    assert spark.read.json(str(tmp_path / "fit")).first()["area_percent"] == 50.1
    (tmp_path / "r.json").write_text(json.dumps([{"sample": "s", "region": "C1s", "component": "x", "total_area": 3.0, "area_percent": 100.0}]))
    assert tables.read_fit_results(spark, str(tmp_path / "r.json")).first()["layer"] == 1
    q = spark.createDataFrame([("a", "C1s", 3.14159, ["low snr"]), ("b", "C1s", None, [])], "sample_id string, region string, snr_xps double, warnings array<string>")
    sinks.write_quality_report(q, str(tmp_path / "q"))
    got = {r["sample_id"]: r for r in tables.read_quality_report(spark, str(tmp_path / "q")).collect()}
    assert got["a"]["snr_xps"] == 3.1416 and got["b"]["snr_xps"] == 0.0 and got["b"]["warnings"] == "None"
    sinks.write_map_products(spark.createDataFrame([("mask", 0, 0, 1.0)], "product string, y int, x int, value double"), str(tmp_path / "m"))
    sinks.append_run_log(spark.createDataFrame([("fit", "success", 1.0)], "step string, status string, duration double"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1 and spark.read.json(str(tmp_path / "log")).count() == 1


def test_settings():
    good = settings.corrected_factors({"rsf_values": {"C1s": {"rsf": 0.3, "corrected_rsf": 6.6}, "bad": {"corrected_rsf": "x"}, "zero": {"corrected_rsf": 0}}})
    assert good == {"C1s": (0.3, 6.6)}
    with pytest.raises(ValueError):
        settings.corrected_factors({})
    r = settings.region_settings({"regions": {"F1s": {"energy_range": [695, 680], "typical_be": 688.0, "focus_clusters": [2]}}})
    assert r["F1s"][:3] == (680.0, 695.0, 688.0) and r["F1s"][6] == [2]


def test_required_columns(spark):
    with pytest.raises(ValueError):
        schemas.require_columns(spark.range(1), "id", "missing")
