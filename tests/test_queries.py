"""A cross-section of the registered queries against SQL; `python -m tests.oracle_check` runs all of them."""

import pytest

import __spark_entry__ as entry
from lumenfold import schemas
from lumenfold.operators import regions as rg
from lumenfold.plans.bindings import KEYS
from lumenfold.plans.queries_spectra import with_flags
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
PICKED = ["quant_atomic_percent", "quant_sanity_check", "quant_component_features", "correlate_matrix", "background_shirley",
          "background_tougaard", "peaks_all", "gate_spectra", "region_detection", "grid_combine", "map_residuals", "map_silhouette",
          "species_maps", "image_segmentation", "calibration_carbon", "fit_evaluation", "source_parser_choice", "source_map_text",
          "triage_files", "stream_drift", "group_every_n", "performance_latest_cycle"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", PICKED)
def test_against_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_same_result_for_any_partitioning(spark):
    rows = []
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(tuple, entry.queries()["calibration_carbon"](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1] == rows[2]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_region_join_is_an_equi_join(spark):
    p = plan(rg.detect_regions(with_flags(spark, SF), schemas.region_defs(spark), KEYS))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(entry.queries()["quant_atomic_percent"](spark, SF))
    assert "l_comment" not in p and "l_shipdate" not in p and "BroadcastHashJoin" in p
    q = plan(entry.queries()["performance_chosen_cycle"](spark, SF))
    assert "o_orderpriority" not in q


def test_shirley_adds_no_shuffle(spark):
    p = plan(entry.queries()["background_shirley"](spark, SF))
    assert p.count("Exchange hashpartitioning") == 1
