"""Queries over peak areas, components, performance records and groups."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lumenfold.functions import scalars as sc
from lumenfold.functions.scalars import rnd
from lumenfold.operators import correlate as co
from lumenfold.operators import groups as gr
from lumenfold.operators import ordering as od
from lumenfold.operators import quant as qn
from lumenfold.operators.forest import forest_importances, forest_predictions
from lumenfold.plans.bindings import (AREAS, COMPONENTS, PERF, RSF, RSF_BINDING, areas, component_rows, components, performance, rsf,
                                      table)
from lumenfold.plans.registry import query
from lumenfold.session import settled

REGS = sorted(RSF_BINDING)
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
AL = ["sample", "layer"]
ALR = ["sample", "layer", "region"]

PCT = f"""{AREAS}, {RSF},
pct AS (SELECT sample, layer, region, area, CASE WHEN sum(area / rsf) OVER w > 0 THEN area / rsf / sum(area / rsf) OVER w * 100 ELSE 0 END AS p FROM areas JOIN rsf USING (region) WINDOW w AS (PARTITION BY sample, layer))"""
SHARE = f"""{COMPONENTS},
sh AS (SELECT *, CASE WHEN sum(area) OVER w > 0 THEN area / sum(area) OVER w * 100 ELSE 0 END AS s FROM comps WINDOW w AS (PARTITION BY sample, layer, region))"""
CPCT = f"""{PCT}, {SHARE},
cp AS (SELECT sh.*, p, p * s / 100 AS c FROM sh LEFT JOIN pct USING (sample, layer, region))"""


def percent(spark, sf):
    return qn.atomic_percent(areas(spark, sf), rsf(spark))


def shares(spark, sf):
    return qn.component_share(components(spark, sf), ALR)


def comp_percent(spark, sf):
    return qn.component_atomic_percent(shares(spark, sf), percent(spark, sf), ALR)


@query("quant_atomic_percent", f"WITH {PCT} SELECT sample, layer, region, round(p, 6) + 0e0 AS atomic_percent FROM pct")
def quant_atomic_percent(spark, sf):
    return percent(spark, sf).select(*ALR, rnd("atomic_percent", 6).alias("atomic_percent"))


@query("quant_element_table", f"WITH {PCT} SELECT sample, layer, " + ", ".join(
    f"round(max(CASE WHEN region = '{r}' THEN p END), 6) + 0e0 AS {r}" for r in REGS) + " FROM pct GROUP BY 1, 2")
def quant_element_table(spark, sf):
    w = qn.wide_by_region(percent(spark, sf), AL, REGS)
    return w.select(*AL, *[rnd(r, 6).alias(r) for r in REGS])


@query("quant_element_long", f"WITH {PCT} SELECT sample, layer, region, round(p, 6) + 0e0 AS atomic_percent FROM pct")
def quant_element_long(spark, sf):
    z = qn.long_by_region(qn.wide_by_region(percent(spark, sf), AL, REGS), AL, REGS)
    return z.select(*ALR, rnd("atomic_percent", 6).alias("atomic_percent"))


@query("quant_missing_factor", f"""WITH {AREAS} SELECT region, count(*) AS n_rows FROM areas WHERE region NOT IN ('AF', 'AO', 'NF') GROUP BY 1""")
def quant_missing_factor(spark, sf):
    return qn.missing_factors(areas(spark, sf), rsf(spark).filter(F.col("region").isin("AF", "AO", "NF")))


@query("quant_first_area", """WITH r AS (SELECT l_suppkey AS sample, l_linenumber AS layer, l_returnflag || l_linestatus AS region, CASE WHEN l_quantity > 5 THEN l_extendedprice END AS total_area, l_orderkey, l_partkey, l_shipdate FROM lineitem)
SELECT sample, layer, region, round(arg_min(total_area, (l_orderkey, l_partkey, total_area)), 4) + 0e0 AS area FROM r WHERE total_area IS NOT NULL GROUP BY 1, 2, 3""")
def quant_first_area(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sample"), F.col("l_linenumber").alias("layer"),
        F.concat("l_returnflag", "l_linestatus").alias("region"), "l_orderkey", "l_partkey",
        F.when(F.col("l_quantity") > 5, F.col("l_extendedprice")).alias("total_area"))
    f = qn.first_area(li, ALR, "total_area", ["l_orderkey", "l_partkey", "total_area"]).filter(F.col("area").isNotNull())
    return f.select(*ALR, rnd("area", 4).alias("area"))


@query("quant_component_share", f"WITH {SHARE} SELECT sample, layer, region, component, round(s, 6) + 0e0 AS area_percent FROM sh")
def quant_component_share(spark, sf):
    return shares(spark, sf).select(*ALR, "component", rnd("area_percent", 6).alias("area_percent"))


@query("quant_drop_minor", f"""WITH {SHARE}, k AS (SELECT sample, layer, region, component, area FROM sh WHERE s >= 5)
SELECT sample, layer, region, component, round(area / sum(area) OVER (PARTITION BY sample, layer, region) * 100, 6) + 0e0 AS area_percent FROM k""")
def quant_drop_minor(spark, sf):
    d = qn.drop_minor(components(spark, sf), ALR, 5.0)
    return d.select(*ALR, "component", rnd("area_percent", 6).alias("area_percent"))


@query("quant_component_atomic_percent", f"WITH {CPCT} SELECT sample, layer, region, component, round(p, 6) + 0e0 AS atomic_percent, round(c, 6) + 0e0 AS component_atomic_percent FROM cp")
def quant_component_atomic_percent(spark, sf):
    return comp_percent(spark, sf).select(*ALR, "component", rnd("atomic_percent", 6).alias("atomic_percent"),
                                          rnd("component_atomic_percent", 6).alias("component_atomic_percent"))


@query("quant_unmatched_components", f"""WITH {CPCT} SELECT region, count(*) AS n_rows, count(*) FILTER (region IN ('RF', 'RO')) AS n_unmatched FROM cp GROUP BY 1""")
def quant_unmatched_components(spark, sf):
    element = percent(spark, sf).filter(~F.col("region").isin("RF", "RO"))
    c = qn.component_atomic_percent(shares(spark, sf), element, ALR)
    return c.groupBy("region").agg(F.count("*").alias("n_rows"), F.count_if(F.col("atomic_percent").isNull()).alias("n_unmatched"))


@query("quant_sanity_check", f"""WITH {CPCT} SELECT sample, layer, region, round(max(p), 6) + 0e0 AS element_percent, round(sum(c), 6) + 0e0 AS sum_components, count(*) AS n_components, round(abs(sum(c) - max(p)), 6) + 0e0 AS gap, abs(sum(c) - max(p)) <= 1 AS passed FROM cp GROUP BY 1, 2, 3""")
def quant_sanity_check(spark, sf):
    s = qn.sanity_check(comp_percent(spark, sf), ALR)
    return s.select(*ALR, rnd("element_percent", 6).alias("element_percent"), rnd("sum_components", 6).alias("sum_components"),
                    "n_components", rnd(F.abs("difference"), 6).alias("gap"), "passed")


FEATURES = [(r, t) for r in REGS for t in TYPES]


def feature_sql(agg: str) -> str:
    return ", ".join(f"coalesce({agg}(CASE WHEN region = '{r}' AND component = '{t}' THEN c END), 0) AS {r}_{t}_perc" for r, t in FEATURES)


NAMES = [f"{r}_{t}_perc" for r, t in FEATURES]


@query("quant_component_features", f"WITH {CPCT}, f AS (SELECT sample, {feature_sql('sum')} FROM cp GROUP BY 1) SELECT sample, " + ", ".join(
    f"round({n}, 5) + 0e0 AS {n}" for n in NAMES) + " FROM f")
def quant_component_features(spark, sf):
    w = qn.component_features(comp_percent(spark, sf), FEATURES, "component_atomic_percent")
    return w.select("sample", *[rnd(n, 5).alias(n) for n in NAMES])


@query("quant_component_features_normalised", f"WITH {CPCT}, f AS (SELECT sample, {feature_sql('avg')} FROM cp GROUP BY 1), t AS (SELECT *, {' + '.join(NAMES)} AS t FROM f) SELECT sample, " + ", ".join(
    f"round({n} / (CASE WHEN t = 0 THEN 1 ELSE t END) * 100, 5) + 0e0 AS {n}" for n in NAMES) + " FROM t")
def quant_component_features_normalised(spark, sf):
    c = comp_percent(spark, sf)
    w = qn.component_features(c, FEATURES, qn.value_column(c), "mean", normalise=True)
    return w.select("sample", *[rnd(n, 5).alias(n) for n in NAMES])


@query("quant_chemistry_group", f"""WITH {CPCT}, m AS (SELECT sample || '_L' || layer AS label, """ + ", ".join(
    f"coalesce(avg(CASE WHEN component = '{t}' THEN c END), 0) AS {t}" for t in TYPES) + """ FROM cp WHERE starts_with(region, 'A') GROUP BY 1)
SELECT label, """ + ", ".join(f"round({t}, 6) + 0e0 AS {t}" for t in TYPES) + f", round({' + '.join(TYPES)}, 5) + 0e0 AS total FROM m")
def quant_chemistry_group(spark, sf):
    label = sc.sample_layer_label(F.col("sample").cast("string"), F.col("layer"))
    w = qn.chemistry_table(comp_percent(spark, sf), "A", TYPES, label)
    return w.select("label", *[rnd(t, 6).alias(t) for t in TYPES], rnd("total", 5).alias("total"))


@query("quant_component_heatmap", f"""WITH {CPCT}, l AS (SELECT sample, component, arg_max(c, layer * 10 + (CASE region """ + " ".join(
    f"WHEN '{r}' THEN {k}" for k, r in enumerate(REGS)) + """ END)) AS v FROM cp GROUP BY 1, 2)
SELECT sample, """ + ", ".join(f"round(coalesce(max(CASE WHEN component = '{t}' THEN v END), 0), 6) + 0e0 AS {t}" for t in TYPES) + " FROM l GROUP BY 1")
def quant_component_heatmap(spark, sf):
    w = qn.last_value_table(comp_percent(spark, sf), ["sample"], "component", TYPES, "component_atomic_percent", ["layer", "region"])
    return w.select("sample", *[rnd(t, 6).alias(t) for t in TYPES])


@query("quant_element_matrix", f"""WITH {PCT}, f AS (SELECT sample, region, arg_min(p, layer) AS v FROM pct GROUP BY 1, 2)
SELECT sample, """ + ", ".join(f"round(coalesce(max(CASE WHEN region = '{r}' THEN v END), 0), 6) + 0e0 AS {r}" for r in REGS) + " FROM f GROUP BY 1")
def quant_element_matrix(spark, sf):
    w = qn.first_value_table(percent(spark, sf), ["sample"], "region", REGS, "atomic_percent", ["layer"])
    return w.select("sample", *[rnd(r, 6).alias(r) for r in REGS])


@query("quant_completeness", f"""WITH {PCT}, k AS (SELECT count(*) AS n FROM (SELECT DISTINCT sample, layer FROM pct))
SELECT region AS name, count(*) AS n_present, round(avg(p), 6) + 0e0 AS mean, round(count(*) / any_value(n), 6) + 0e0 AS rate FROM pct, k GROUP BY 1""")
def quant_completeness(spark, sf):
    c = qn.completeness(qn.wide_by_region(percent(spark, sf), AL, REGS), REGS)
    return c.select("name", "n_present", rnd("mean", 6).alias("mean"), rnd("rate", 6).alias("rate"))


@query("quant_distinct_samples", f"WITH {AREAS} SELECT region, count(DISTINCT sample) AS n_samples, count(*) AS n_rows FROM areas GROUP BY 1")
def quant_distinct_samples(spark, sf):
    return areas(spark, sf).groupBy("region").agg(F.countDistinct("sample").alias("n_samples"), F.count("*").alias("n_rows"))


@query("quant_component_total_share", f"WITH {COMPONENTS} SELECT component, round(sum(area) / (SELECT sum(area) FROM comps) * 100, 6) + 0e0 AS share FROM comps GROUP BY 1")
def quant_component_total_share(spark, sf):
    # line items are added up by component in the task that joins them, without a sum for each sample, layer and region
    t = component_rows(spark, sf)[0].groupBy("component").agg(F.sum("area").alias("area")).withColumn("_all", F.lit(1))
    d = qn.component_share(t, ["_all"])
    return d.select("component", rnd("area_percent", 6).alias("share"))


@query("quant_layer_order", f"""WITH {PCT}, d AS (SELECT sample, region, arg_min(p, layer) AS surface, arg_max(p, layer) AS bulk FROM pct GROUP BY 1, 2)
SELECT sample, region, round(surface, 6) + 0e0 AS surface, round(bulk, 6) + 0e0 AS bulk, round(bulk - surface, 5) + 0e0 AS change FROM d""")
def quant_layer_order(spark, sf):
    d = percent(spark, sf).groupBy("sample", "region").agg(F.min_by("atomic_percent", "layer").alias("surface"),
                                                           F.max_by("atomic_percent", "layer").alias("bulk"))
    return d.select("sample", "region", rnd("surface", 6).alias("surface"), rnd("bulk", 6).alias("bulk"),
                    rnd(F.col("bulk") - F.col("surface"), 5).alias("change"))


@query("quant_outliers", f"""WITH {SHARE}, g AS (SELECT region, component, avg(s) AS m, stddev_samp(s) AS d FROM sh GROUP BY 1, 2)
SELECT sample, layer, region, component, round((s - m) / d, 5) + 0e0 AS z_score FROM sh JOIN g USING (region, component) WHERE abs((s - m) / d) > 25e-1""")
def quant_outliers(spark, sf):
    o = qn.outliers(shares(spark, sf), ["region", "component"], "area_percent", 2.5)
    return o.select(*ALR, "component", rnd("z_score", 5).alias("z_score"))


@query("quant_union_tables", f"""WITH {COMPONENTS}, a AS (SELECT region, component AS label, area FROM comps UNION ALL SELECT l_returnflag || l_linestatus, NULL, l_tax FROM lineitem)
SELECT region, coalesce(label, '-') AS label, count(*) AS n, round(sum(area), 2) + 0e0 AS total FROM a GROUP BY 1, 2""")
def quant_union_tables(spark, sf):
    a = components(spark, sf).select("region", F.col("component").alias("label"), "area")
    b = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("region"), F.col("l_tax").alias("area"))
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("region", F.coalesce("label", F.lit("-")).alias("label")).agg(
        F.count("*").alias("n"), rnd(F.sum("area"), 2).alias("total"))


@query("run_latest", """WITH r AS (SELECT strftime(o_orderdate, '%Y%m%d') || '000000' AS run_id, o_orderstatus AS status, o_totalprice AS v FROM orders)
SELECT run_id, status, count(*) AS n, round(sum(v), 2) + 0e0 AS total FROM r WHERE run_id = (SELECT max(run_id) FROM r) GROUP BY 1, 2""")
def run_latest(spark, sf):
    o = table(spark, sf, "orders")
    r = o.select(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("000000")).alias("run_id"),
                 F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("v"))
    return qn.latest_run(r).groupBy("run_id", "status").agg(F.count("*").alias("n"), rnd(F.sum("v"), 2).alias("total"))


@query("run_summary", """SELECT event_type AS step, count(*) AS n, count(*) FILTER (value < 300) AS n_success, round(avg(value), 6) + 0e0 AS mean_duration, round(count(*) FILTER (value < 300) / count(*), 6) + 0e0 AS success_rate FROM events GROUP BY 1""")
def run_summary(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("step"), F.col("value").alias("duration"),
                                            F.when(F.col("value") < 300, "success").otherwise("failed").alias("status"))
    s = qn.run_summary(log)
    return s.select("step", "n", "n_success", rnd("mean_duration", 6).alias("mean_duration"), rnd("success_rate", 6).alias("success_rate"))


# ---- performance ------------------------------------------------------------

def nulled(spark, sf):
    p = performance(spark, sf)
    return p.withColumn("cycle", F.when(F.col("status") != "P", F.col("cycle")))


LATEST = f"""{PERF}, pn AS (SELECT sample, ordinal, CASE WHEN status <> 'P' THEN cycle END AS cycle, retention, fade FROM perf),
la AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY cycle DESC NULLS LAST, CASE WHEN cycle IS NULL THEN -ordinal ELSE ordinal END) AS rn FROM pn)"""


@query("performance_latest_cycle", f"WITH {LATEST} SELECT sample, ordinal, coalesce(cycle, -1) AS cycle, round(retention, 6) + 0e0 AS retention FROM la WHERE rn = 1")
def performance_latest_cycle(spark, sf):
    b = co.latest_cycle(nulled(spark, sf))
    return b.select("sample", "ordinal", F.coalesce("cycle", F.lit(-1)).alias("cycle"), rnd("retention", 6).alias("retention"))


@query("performance_chosen_cycle", f"WITH {PERF} SELECT sample, ordinal, round(fade, 6) + 0e0 AS fade FROM perf WHERE cycle = 12")
def performance_chosen_cycle(spark, sf):
    return co.latest_cycle(performance(spark, sf), of_interest=12).select("sample", "ordinal", rnd("fade", 6).alias("fade"))


@query("performance_read", """SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice / 5e3, 6) + 0e0 END AS retention, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(1e2 - o_totalprice / 5e3, 6) + 0e0 END AS fade FROM orders""")
def performance_read(spark, sf):
    from lumenfold.sources.tables import clean_performance
    text = performance(spark, sf).select(
        F.col("sample").alias("Sample"), F.col("ordinal").alias("ordinal"), F.col("cycle").cast("string").alias("Cycle"),
        F.when(F.pmod("ordinal", F.lit(7)) == 0, "n/a").otherwise(F.col("retention").cast("string")).alias("Capacity retention"))
    p = clean_performance(text)
    return p.select("ordinal", rnd("capacity_retention", 6).alias("retention"), rnd("capacity_fade", 6).alias("fade"))


COMPOSITION = f"""co0 AS (SELECT o_custkey AS sample, l_returnflag || l_linestatus AS region, sum(l_extendedprice) AS area FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
co1 AS (SELECT *, area / sum(area) OVER (PARTITION BY sample) * 100 AS p FROM co0),
comp AS (SELECT sample, """ + ", ".join(f"coalesce(max(CASE WHEN region = '{r}' THEN p END), 0) AS {r}_perc" for r in REGS) + " FROM co1 GROUP BY 1)"
FEAT = [f"{r}_perc" for r in REGS]


def composition(spark, sf):
    """Share of each region in a customer's area; lineitem is pre-summed per order before the join."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("region")) \
        .agg(F.sum("l_extendedprice").alias("area"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sample"))
    a = li.join(o, "l_orderkey").groupBy("sample", "region").agg(F.sum("area").alias("area"))
    p = qn.component_share(a, ["sample"], out="p")
    w = qn.wide_by_region(p, ["sample"], REGS, "p", fill=0.0)
    return w.select("sample", *[F.col(r).alias(f"{r}_perc") for r in REGS])


def merged(spark, sf):
    return composition(spark, sf).join(co.latest_cycle(performance(spark, sf)).select("sample", "cycle", "retention", "fade"), "sample")


MERGED = f"""{PERF}, {COMPOSITION}, lb AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY cycle DESC, ordinal) AS rn FROM perf),
mg AS (SELECT comp.*, cycle, retention, fade FROM comp JOIN lb USING (sample) WHERE rn = 1)"""


@query("correlate_merge", f"WITH {MERGED} SELECT sample, cycle, round(fade, 6) + 0e0 AS fade, " + ", ".join(f"round({f}, 5) + 0e0 AS {f}" for f in FEAT) + " FROM mg")
def correlate_merge(spark, sf):
    return merged(spark, sf).select("sample", "cycle", rnd("fade", 6).alias("fade"), *[rnd(f, 5).alias(f) for f in FEAT])


@query("correlate_overlap", f"""WITH a AS (SELECT DISTINCT o_custkey AS s FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT DISTINCT c_custkey AS s FROM customer WHERE c_acctbal > 0)
SELECT (SELECT count(*) FROM (SELECT s FROM a INTERSECT SELECT s FROM b)) AS n_both, (SELECT count(*) FROM (SELECT s FROM a EXCEPT SELECT s FROM b)) AS n_left_only, (SELECT count(*) FROM (SELECT s FROM b EXCEPT SELECT s FROM a)) AS n_right_only""")
def correlate_overlap(spark, sf):
    a = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "F").select(F.col("o_custkey").alias("sample"))
    b = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("sample"))
    return co.id_overlap(a, b)


MATRIX = [*FEAT, "retention", "fade"]


@query("correlate_matrix", f"WITH {MERGED}" + " UNION ALL ".join(
    f" SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0e0 AS r FROM mg" for a in MATRIX for b in MATRIX))
def correlate_matrix(spark, sf):
    m = co.correlation_matrix(merged(spark, sf), MATRIX)
    return m.select("a", "b", rnd("r", 6).alias("r"))


@query("correlate_trend", f"""WITH {MERGED} SELECT count(*) AS n, round(corr(AF_perc, fade), 6) + 0e0 AS r, round(regr_slope(fade, AF_perc), 6) + 0e0 AS slope, round(regr_intercept(fade, AF_perc), 5) + 0e0 AS intercept,
round(corr(AF_perc, fade) * sqrt((count(*) - 2) / (1 - corr(AF_perc, fade) * corr(AF_perc, fade))), 5) + 0e0 AS t FROM mg""")
def correlate_trend(spark, sf):
    t = co.trend(merged(spark, sf), "AF_perc", "fade")
    return t.select("n", rnd("r", 6).alias("r"), rnd("slope", 6).alias("slope"), rnd("intercept", 5).alias("intercept"), rnd("t", 5).alias("t"))


@query("correlate_p_value", f"WITH {MERGED}, tr AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n, corr({f}, fade) AS r FROM mg" for f in FEAT) + """),
h AS (SELECT feature, n, asin(sqrt(1 - r * r)) AS top FROM tr),
z AS (SELECT feature, n, top, k, CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w FROM h, range(4001) t(k)),
q AS (SELECT feature, n, sum(w * pow(sin(top * k / 4000), n - 3)) * top AS part, sum(w * pow(sin(pi() / 2 * k / 4000), n - 3)) * pi() / 2 AS whole FROM z GROUP BY feature, n, top)
SELECT feature, n, round(part / whole, 6) + 0e0 AS p FROM q""")
def correlate_p_value(spark, sf):
    t = co.trend_table(merged(spark, sf), FEAT, "fade").withColumn("p", co.two_sided_p("r", "n"))
    return t.select("feature", "n", rnd("p", 6).alias("p"))


@query("correlate_trend_table", f"WITH {MERGED}" + " UNION ALL ".join(
    f" SELECT '{f}' AS feature, count(*) AS n, round(corr({f}, fade), 6) + 0e0 AS r, round(regr_slope(fade, {f}), 6) + 0e0 AS slope, round(regr_intercept(fade, {f}), 5) + 0e0 AS intercept FROM mg" for f in FEAT))
def correlate_trend_table(spark, sf):
    t = co.trend_table(merged(spark, sf), FEAT, "fade")
    return t.select("feature", "n", rnd("r", 6).alias("r"), rnd("slope", 6).alias("slope"), rnd("intercept", 5).alias("intercept"))


def forest_split(spark, sf):
    """Training and test rows; the merged table is worked out once."""
    return co.split_by_hash(settled(merged(spark, sf).select("sample", "fade", *FEAT), "merged"), "sample")


@query("correlate_forest_metrics")
def correlate_forest_metrics(spark, sf):
    train, test = forest_split(spark, sf)
    rows = test.select(F.array(*FEAT).alias("x"), "fade")
    return co.regression_metrics(forest_predictions(train, rows, FEAT, "fade", trees=500), "fade")


@query("correlate_forest_importance")
def correlate_forest_importance(spark, sf):
    train, _ = forest_split(spark, sf)
    return forest_importances(train, FEAT, "fade", trees=500)


@query("correlate_permutation_importance")
def correlate_permutation_importance(spark, sf):
    train, test = forest_split(spark, sf)
    rows = co.permuted(test, FEAT, "fade").withColumn("features", vector_to_array("features"))
    return co.permutation_loss(forest_predictions(train, rows, FEAT, "fade", trees=500, x="features"), FEAT, "fade")


@query("correlate_histogram", f"""WITH {AREAS}, b AS (SELECT region, min(area) AS lo, max(area) AS hi FROM areas GROUP BY 1)
SELECT region, CAST(least(19, floor((area - lo) / (hi - lo) * 20)) AS INTEGER) AS bin, count(*) AS n FROM areas JOIN b USING (region) GROUP BY 1, 2""")
def correlate_histogram(spark, sf):
    from lumenfold.operators.images import histogram
    return histogram(areas(spark, sf), ["region"], "area", 20).select("region", "bin", "n")


# ---- drift and names --------------------------------------------------------

@query("drift_report", """WITH p AS (SELECT c_mktsegment AS instrument, o_orderkey AS ordinal, 2848e-1 + (CASE WHEN o_totalprice > 480000 THEN 6e0 WHEN o_totalprice > 450000 THEN 7e-1 ELSE 1e-1 END) AS peak FROM orders JOIN customer ON c_custkey = o_custkey),
q AS (SELECT *, peak - 2848e-1 AS shift FROM p)
SELECT instrument, count(*) AS n_samples, min(CASE WHEN abs(shift) > 5e-1 THEN ordinal END) AS drift_start, round(arg_min(shift, CASE WHEN abs(shift) > 5e-1 THEN ordinal END), 4) AS magnitude, count(*) FILTER (abs(shift) > 5e-1) AS n_shifted,
CASE WHEN abs(arg_min(shift, CASE WHEN abs(shift) > 5e-1 THEN ordinal END)) > 5 THEN 'critical' WHEN count(*) FILTER (abs(shift) > 5e-1) = 0 THEN 'none' ELSE 'warning' END AS severity FROM q GROUP BY 1""")
def drift_report(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("instrument"))
    v = F.col("o_totalprice")
    p = o.join(c, "o_custkey").select("instrument", F.col("o_orderkey").alias("ordinal"), F.lit(284.8).alias("target"),
                                      (284.8 + F.when(v > 480000, 6.0).when(v > 450000, 0.7).otherwise(0.1)).alias("peak"))
    d = qn.drift_report(p, ["instrument"], "ordinal", "peak", "target")
    return d.select("instrument", "n_samples", "drift_start", rnd("magnitude", 4).alias("magnitude"), "n_shifted", "severity")


@query("name_natural_order", r"""WITH n AS (SELECT DISTINCT l_returnflag || '_' || l_suppkey || 'b' || l_linenumber AS name FROM lineitem)
SELECT name, list_aggregate(list_transform(regexp_extract_all(lower(name), '(\d+|\D+)'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(p, 12, '0') ELSE p END), 'string_agg', '') AS sort_key FROM n""")
def name_natural_order(spark, sf):
    li = table(spark, sf, "lineitem")
    n = li.select(F.concat("l_returnflag", F.lit("_"), F.col("l_suppkey").cast("string"), F.lit("b"),
                           F.col("l_linenumber").cast("string")).alias("name")).distinct()
    return n.select("name", sc.natural_key(F.col("name")).alias("sort_key"))


@query("name_unique", """WITH n AS (SELECT DISTINCT p_name, p_brand FROM part)
SELECT p_brand, p_name, CASE WHEN rn = 1 THEN s ELSE s || '_' || rn END AS unique_name FROM (SELECT *, split_part(p_name, ' ', 1) AS s, row_number() OVER (PARTITION BY p_brand, split_part(p_name, ' ', 1) ORDER BY p_name) AS rn FROM n)""")
def name_unique(spark, sf):
    n = table(spark, sf, "part").select("p_name", "p_brand").distinct().withColumn("s", F.split("p_name", " ")[0])
    return od.unique_names(n, "s", ["p_name"], scope=["p_brand"]).select("p_brand", "p_name", "unique_name")


@query("name_scalars", r"""WITH n AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS l, l_returnflag AS f FROM lineitem), m AS (SELECT *, 'data/run/S' || s || '_C1s_L' || l || (CASE f WHEN 'A' THEN '.csv' WHEN 'N' THEN '.VMS' ELSE '.zip' END) AS path FROM n)
SELECT path, regexp_replace(regexp_replace(path, '^.*/', ''), '(?i)\.(csv|vms)$', '') AS bare, 'S' || s AS base, 'S' || s || '_L' || l AS label, 'C' AS element, regexp_replace(path, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, 'C1s' AS token FROM m""")
def name_scalars(spark, sf):
    n = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("l"), F.col("l_returnflag").alias("f")).distinct()
    ext = F.when(F.col("f") == "A", ".csv").when(F.col("f") == "N", ".VMS").otherwise(".zip")
    stem = F.concat(F.lit("S"), F.col("s").cast("string"), F.lit("_C1s_L"), F.col("l").cast("string"))
    m = n.select("l", stem.alias("stem"), F.concat(F.lit("data/run/"), stem, ext).alias("path"))
    base = sc.base_sample(F.col("stem"), F.lit("C1s"), F.col("l"))
    token = sc.region_token(F.regexp_replace("path", "C1s", "c1S"))
    return m.select("path", sc.strip_path_and_extension(F.col("path")).alias("bare"), base.alias("base"),
                    sc.sample_layer_label(base, F.col("l")).alias("label"), sc.element_of(token).alias("element"),
                    sc.safe_name(F.col("path")).alias("safe"), token.alias("token"))


@query("name_run_tag", r"""SELECT o_orderkey, substr(regexp_replace(CAST(o_orderdate AS VARCHAR), '\D', '', 'g'), 1, 14) AS tag FROM orders""")
def name_run_tag(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", sc.run_tag(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("tag"))


@query("performance_columns", """SELECT o_orderkey, round(o_totalprice, 2) + 0e0 AS Rct, round(o_custkey, 2) + 0e0 AS RSEI FROM orders""")
def performance_columns(spark, sf):
    from lumenfold.sources.tables import clean_columns
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("R-(ct)"), F.col("o_custkey").alias("R-(SEI)"))
    c = clean_columns(o)
    return c.select("o_orderkey", rnd("Rct", 2).alias("Rct"), rnd("RSEI", 2).alias("RSEI"))


@query("calibration_mode_rule", """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'foil|au4f|ag3d|cu2p|ir4f|metallic ref') THEN 'metallic_reference' WHEN regexp_matches(lower(text), 'fermi|valence|conductor|metal film') THEN 'fermi_edge'
WHEN regexp_matches(lower(text), 'no calibration|skip calibration|disable') THEN 'disable' ELSE 'adventitious_carbon' END AS mode FROM documents""")
def calibration_mode_rule(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sc.calibration_mode(F.col("text")).alias("mode"))


# ---- groups -----------------------------------------------------------------

def customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("n"), F.concat(
        F.col("c_mktsegment"), F.lit("_"), F.col("c_custkey").cast("string")).alias("sample"))


CUST = "cu AS (SELECT c_custkey AS n, c_mktsegment || '_' || c_custkey AS sample, c_mktsegment AS seg FROM customer)"


@query("group_ranges", f"""WITH {CUST} SELECT sample, coalesce(CASE WHEN n BETWEEN 1 AND 100 THEN 'A' WHEN n BETWEEN 90 AND 400 THEN 'B' END, '-') AS "group" FROM cu""")
def group_ranges(spark, sf):
    g = gr.by_ranges(customers(spark, sf), [(1, 100, "A"), (90, 400, "B")])
    return g.select("sample", F.coalesce("group", F.lit("-")).alias("group"))


@query("group_parity", f"""WITH {CUST} SELECT sample, CASE WHEN n % 2 = 1 THEN 'odd' ELSE 'even' END AS "group" FROM cu""")
def group_parity(spark, sf):
    return gr.by_parity(customers(spark, sf)).select("sample", "group")


@query("group_first_rest", f"""WITH {CUST} SELECT sample, CASE WHEN row_number() OVER (ORDER BY n) <= 40 THEN 'first' ELSE 'rest' END AS "group" FROM cu""")
def group_first_rest(spark, sf):
    return gr.first_and_rest(customers(spark, sf), 40, ["n"]).select("sample", "group")


@query("group_every_n", f"""WITH {CUST} SELECT sample, 'G' || ((row_number() OVER (ORDER BY n) - 1) // 7 + 1) AS "group" FROM cu""")
def group_every_n(spark, sf):
    return gr.every_n(customers(spark, sf), 7, F.col("n")).select("sample", "group")


@query("group_prefix", f"""WITH {CUST}, s AS (SELECT seg, count(*) AS c FROM cu GROUP BY 1) SELECT sample, seg AS "group" FROM cu JOIN s USING (seg) WHERE c >= 3""")
def group_prefix(spark, sf):
    return gr.by_prefix(customers(spark, sf), min_size=3).select("sample", "group")


@query("group_lists", f"""WITH {CUST} SELECT sample, coalesce(CASE WHEN seg = 'MACHINERY' THEN 'x' WHEN seg IN ('HOUSEHOLD', 'FURNITURE') THEN 'y' END, '-') AS "group" FROM cu""")
def group_lists(spark, sf):
    c = customers(spark, sf).withColumn("seg", F.split("sample", "_")[0])
    g = gr.by_lists(c, {"x": ["MACHINERY"], "y": ["HOUSEHOLD", "FURNITURE"]}, "seg")
    return g.select("sample", F.coalesce("group", F.lit("-")).alias("group"))
