"""Queries over text that Spark derives from the tables, and the checks of its parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.scalars import rnd
from lumenfold.operators import points as pt
from lumenfold.operators import quality as ql
from lumenfold.plans.bindings import AREAS, KEYS, MAP, PTS, RSF_BINDING, areas, labelled, map_spectra, recorded_points, table
from lumenfold.plans.registry import query
from lumenfold.sources import sinks as sk
from lumenfold.sources import text as tx


def packed(spark, sf):
    return labelled(pt.pack(recorded_points(spark, sf), KEYS, ("energy", "raw")))


def numbers_text(a, sep=","):
    return F.array_join(F.transform(a, lambda v: v.cast("string")), sep)


def pairs_text(sep=","):
    return F.array_join(F.zip_with("energy", "raw", lambda e, y: F.concat(e.cast("string"), F.lit(sep), y.cast("string"))), "\n")


def with_lines(df, text):
    return pt.materialise(df.withColumn("text", text), lines=tx.lines_of(F.col("text"))).drop("energy", "raw", "text")


def exploded(df):
    return tx.explode_points(df).select(*KEYS, "region", "layer", "i", rnd("energy", 4).alias("energy"), rnd("intensity", 4).alias("intensity"))


LONG = f"""WITH {PTS} SELECT instrument, CAST(sweep AS BIGINT) AS sweep, {{region}} AS region, {{layer}} AS layer, i, round(energy, 4) + 0e0 AS energy, round(raw, 4) + 0e0 AS intensity FROM pts"""
ATLEAST3 = " WHERE (SELECT count(*) FROM pts q WHERE q.instrument = pts.instrument AND q.sweep = pts.sweep) >= 3"


@query("source_two_column", LONG.format(region="'-'", layer="CAST(1 AS INTEGER)"))
def source_two_column(spark, sf):
    sep = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t"), F.lit("  ")), (F.pmod("instrument", F.lit(4)) + 1).cast("int"))
    body = F.array_join(F.zip_with("energy", "raw", lambda e, y: F.concat(e.cast("string"), sep, y.cast("string"))), "\r\n")
    d = with_lines(packed(spark, sf).drop("region", "layer"), F.concat(F.lit("# recorded\nenergy,counts\n"), body))
    d = tx.parse_two_column(d).drop("lines")
    return exploded(d).withColumn("region", F.coalesce("region", F.lit("-")))


@query("source_sections", LONG.format(region="region", layer="CAST(1 AS INTEGER)") + ATLEAST3)
def source_sections(spark, sf):
    text = F.concat(F.lit("exported\n"), F.lower("region"), F.lit("\ndwell 0.1 s\n"), pairs_text(), F.lit("\nend of data\n"))
    d = with_lines(packed(spark, sf), text).drop("region", "layer")
    return exploded(tx.parse_sections(d).drop("lines"))


@query("source_paired_rows", LONG.format(region="region", layer="CAST(1 AS INTEGER)") + ATLEAST3)
def source_paired_rows(spark, sf):
    text = F.concat(F.lit("\n"), "region", F.lit("\n"), numbers_text(F.col("energy")), F.lit("\n"), numbers_text(F.col("raw")), F.lit("\n"))
    d = with_lines(packed(spark, sf), text).drop("region", "layer")
    return exploded(tx.parse_paired_rows(d).drop("lines"))


@query("source_region_table", f"""WITH {PTS}, u AS (SELECT instrument, sweep, region, i, energy, raw + 5e-1 AS v FROM pts UNION ALL SELECT instrument, sweep, 'Cl2p', i, energy - 50, raw * 2 FROM pts)
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, region, CAST(1 AS INTEGER) AS layer, i, round(energy, 4) + 0e0 AS energy, round(v, 4) + 0e0 AS intensity FROM u WHERE (SELECT count(*) FROM pts q WHERE q.instrument = u.instrument AND q.sweep = u.sweep) >= 3""")
def source_region_table(spark, sf):
    """Two replicates for the first region, whose mean is raw + 0.5, and one column for the second."""
    row = F.zip_with("energy", "raw", lambda e, y: F.concat_ws(",", e.cast("string"), y.cast("string"), (y + 1).cast("string"), (e - 50).cast("string"), (y * 2).cast("string")))
    text = F.concat(F.lit("run\n"), "region", F.lit(",a,b,cl2p,a\n"), F.array_join(row, "\n"))
    d = with_lines(packed(spark, sf), text).drop("region", "layer")
    return exploded(tx.parse_region_table(d).drop("lines"))


@query("source_depth_table", f"""WITH {PTS}, u AS (SELECT instrument, sweep, region, 1 AS layer, i, energy, raw AS v FROM pts UNION ALL SELECT instrument, sweep, region, 2, i, energy, raw + 1 FROM pts UNION ALL SELECT instrument, sweep, 'Cl2p', 1, i, energy - 50, raw * 2 FROM pts)
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, region, CAST(layer AS INTEGER) AS layer, i, round(energy, 4) + 0e0 AS energy, round(v, 4) + 0e0 AS intensity FROM u WHERE (SELECT count(*) FROM pts q WHERE q.instrument = u.instrument AND q.sweep = u.sweep) >= 3""")
def source_depth_table(spark, sf):
    row = F.zip_with("energy", "raw", lambda e, y: F.concat_ws(",", e.cast("string"), y.cast("string"), (y + 1).cast("string"), (e - 50).cast("string"), (y * 2).cast("string")))
    text = F.concat("region", F.lit(",,,cl2p,\n,1,2,,1\n"), F.array_join(row, "\n"))
    d = with_lines(packed(spark, sf), text).drop("region", "layer")
    return exploded(tx.parse_depth_table(d).drop("lines"))


@query("source_blocks", f"""WITH {PTS} SELECT instrument, CAST(sweep AS BIGINT) AS sweep, region, CAST(7 AS INTEGER) AS block, 235e-1 AS pass_energy, count(*) AS n, round(max(14866e-1 - (energy + 400)), 4) + 0e0 AS top_ev, round(sum(raw), 3) + 0e0 AS total FROM pts GROUP BY 1, 2, 3""")
def source_blocks(spark, sf):
    title = F.concat(F.regexp_replace("region", r"(\d)", " $1"), F.lit("/7"))
    body = F.array_join(F.zip_with("energy", "raw", lambda e, y: F.concat((e + 400).cast("string"), F.lit(" "), y.cast("string"))), "\n")
    d = with_lines(packed(spark, sf), F.concat(title, F.lit("\nanalyser pass energy 23.5\nkinetic\n"), F.size("raw").cast("string"), F.lit("\n"), body, F.lit("\n"))).drop("region", "layer")
    b = tx.parse_blocks(d)
    be = tx.to_binding(F.col("energy"), F.lit(True))
    return b.select(*KEYS, "region", "block", "pass_energy", F.size("energy").cast("bigint").alias("n"), rnd(F.array_max(be), 4).alias("top_ev"),
                    rnd(F.aggregate("intensity", F.lit(0.0), lambda s, v: s + v), 3).alias("total"))


@query("source_parser_choice", f"""WITH {PTS}, g AS (SELECT instrument, sweep, count(*) AS n FROM pts GROUP BY 1, 2), p AS (SELECT *, CASE instrument % 4 WHEN 0 THEN 'region_table' WHEN 1 THEN 'paired_rows' WHEN 2 THEN 'sections' ELSE 'two_column' END AS q FROM g)
SELECT instrument, CAST(sweep AS BIGINT) AS sweep, CASE WHEN n < 3 THEN '?' ELSE q END AS parser, CASE WHEN n < 3 THEN 0 ELSE n * (CASE q WHEN 'region_table' THEN 2 ELSE 1 END) END AS n_points FROM p""")
def source_parser_choice(spark, sf):
    p = packed(spark, sf)
    row = F.zip_with("energy", "raw", lambda e, y: F.concat_ws(",", e.cast("string"), y.cast("string"), (e - 50).cast("string"), (y * 2).cast("string")))
    a = F.concat("region", F.lit(",a,cl2p,a\n"), F.array_join(row, "\n"))
    b = F.concat("region", F.lit("\n"), numbers_text(F.col("energy")), F.lit("\n"), numbers_text(F.col("raw")))
    c = F.concat("region", F.lit("\nnotes\n"), pairs_text())
    r = F.pmod("instrument", F.lit(4))
    d = with_lines(p, F.when(r == 0, a).when(r == 1, b).when(r == 2, c).otherwise(pairs_text(" "))).drop("region", "layer")
    z = tx.parse_files(d)
    short = F.col("n") < 3
    n = p.select(*KEYS, F.size("raw").alias("n"))
    return z.select(*KEYS, "parser", F.size("points").cast("bigint").alias("m")).join(n, KEYS).select(
        *KEYS, F.when(short, "?").otherwise(F.col("parser")).alias("parser"), F.when(short, 0).otherwise(F.col("m")).alias("n_points"))


@query("source_aggregated", f"""WITH {PTS}, k AS (SELECT instrument, sweep FROM pts GROUP BY 1, 2 HAVING count(*) >= 5) SELECT instrument, CAST(sweep // 2 AS BIGINT) AS export, 'scan_L' || (sweep % 2 + 1) AS label, CAST(sweep % 2 + 1 AS INTEGER) AS layer, i, round(raw, 4) + 0e0 AS intensity FROM pts JOIN k USING (instrument, sweep)""")
def source_aggregated(spark, sf):
    """Pairs of sweeps as one combined export with two intensity columns, read back as single spectra."""
    p = recorded_points(spark, sf).withColumn("export", F.floor(F.col("sweep") / 2)).withColumn("_k", F.pmod("sweep", F.lit(2)))
    wide = p.groupBy("instrument", "export", "i").pivot("_k", [0, 1]).agg(F.first("raw"))
    wide = wide.select("instrument", "export", F.col("i").cast("string").alias("Binding_Energy_eV"), F.coalesce(F.col("0").cast("string"), F.lit("nan")).alias("Intensity_scan_L1"), F.col("1").cast("string").alias("scan_L2_cps"))
    z = tx.unpivot_aggregated(wide)
    return z.select("instrument", "export", "label", "layer", F.col("energy").cast("int").alias("i"), rnd("intensity", 4).alias("intensity"))


@query("source_map_text", f"""WITH {MAP}, k AS (SELECT y, x, vec_id, CAST(sum(v) AS DOUBLE) AS t, max(v) AS m FROM mp GROUP BY 1, 2, 3), ex AS (SELECT y AS f, unnest(range(30)) AS x FROM (SELECT DISTINCT y FROM k))
SELECT ex.f AS file, CAST(ex.x // 5 AS INTEGER) AS y, CAST(ex.x % 5 AS INTEGER) AS x, 'C1s' AS region, round(coalesce(t, 0), 4) + 0e0 AS total, CASE WHEN ex.f % 2 = 0 THEN 300e0 ELSE 295e0 END AS last_ev FROM ex LEFT JOIN k ON k.y = ex.f AND k.x = ex.x""")
def source_map_text(spark, sf):
    """Each line of the map becomes a file of 5 x 6 pixels whose last row is missing; even files carry an energy row."""
    m = map_spectra(spark, sf)
    w = F.struct("x", numbers_text(F.col("intensity"), " ").alias("t"))
    f = m.groupBy("y").agg(F.array_sort(F.collect_list(w)).alias("r"))  # one line of the map: its width in pixels
    axis = F.when(F.pmod("y", F.lit(2)) == 0, F.concat(F.lit("# binding energy\n"), numbers_text(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda c: 281.1 + 0.3 * c)), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("map of 12-Mar\nC 1s\n0.0\n1.0\n5\n0.0, 1.0\n6\n# comment\n"), axis, F.array_join(F.transform("r", lambda p: p["t"]), "\n"))
    d = pt.materialise(f.select(F.col("y").alias("file"), text.alias("text")), lines=tx.lines_of(F.col("text")))
    maps = tx.parse_maps(d)
    last = maps.select("file", F.round(F.element_at("energy", -1), 4).alias("last_ev"))
    px = tx.map_pixels_of(maps).join(last, "file")
    return px.select("file", "y", "x", "region", rnd(F.aggregate("intensity", F.lit(0.0), lambda s, v: s + v), 4).alias("total"), "last_ev")


@query("source_map_rows", f"WITH {MAP} SELECT y AS file, count(*) AS n_rows, CAST(25 AS INTEGER) AS nx, CAST(max(y) + 1 AS INTEGER) AS ny FROM px GROUP BY 1")
def source_map_rows(spark, sf):
    m = map_spectra(spark, sf)
    f = m.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", numbers_text(F.col("intensity"), " ").alias("t")))).alias("r"))
    text = F.concat(F.lit("C1s\nX size: 25\nHeight = "), (F.col("y") + 1).cast("string"), F.lit("\n1 2 3 4 5 6"), F.repeat(F.lit(" 7"), 58), F.lit("\n"), F.array_join(F.transform("r", lambda p: p["t"]), "\n"))
    d = pt.materialise(f.select(F.col("y").alias("file"), text.alias("text")), lines=tx.lines_of(F.col("text")))
    dims = tx.header_dims(F.col("lines"))
    return d.select("file", tx.count_map_rows(F.col("lines")).cast("bigint").alias("n_rows"), dims["nx"].alias("nx"), dims["ny"].alias("ny"))


REGS = sorted(RSF_BINDING)


@query("source_concentrations", f"""WITH {AREAS} SELECT 'S' || sample AS sample, CAST(row_number() OVER (PARTITION BY sample, region ORDER BY layer) AS INTEGER) AS layer, CASE region """ + " ".join(
    f"WHEN '{r}' THEN 'E{k}s'" for k, r in enumerate(REGS)) + """ END AS element, round(floor(area / 1e3) / 4, 4) + 0e0 AS percent FROM areas""")
def source_concentrations(spark, sf):
    """The area table written as concentration text per sample and read back."""
    wide = areas(spark, sf).withColumn("v", F.floor(F.col("area") / 1000) / 4).groupBy("sample", "layer").pivot("region", REGS).agg(F.first("v"))
    row = F.struct("layer", F.concat_ws("  ", *[F.col(r).cast("string") for r in REGS]).alias("t"))
    f = wide.groupBy("sample").agg(F.array_sort(F.collect_list(row)).alias("r"))  # one entry per layer
    head = "  ".join(f"E{k}s" for k in range(len(REGS)))
    text = F.concat(F.lit('File Name: "S'), F.col("sample").cast("string"), F.lit(f'"\nsummary\nAtomic Concentration Table\n-----\n{head}\nRSF 1 1 1 1 1 1\n'),
                    F.array_join(F.transform("r", lambda p: p["t"]), "\n"), F.lit("\nMean 1 2 3 4 5 6\nStd Dev 1 1 1 1 1 1\nWeight % Table\n9 9 9 9 9 9\n"))
    d = pt.materialise(f.select(text.alias("text")), lines=tx.lines_of(F.col("text"))).drop("text")
    return tx.parse_concentrations(d).select("sample", "layer", "element", rnd("percent", 4).alias("percent"))


@query("source_fit_json", f"""WITH {AREAS} SELECT sample, CASE WHEN layer = 1 THEN 1 ELSE layer END AS layer, region, round(area, 2) + 0e0 AS total_area FROM areas""")
def source_fit_json(spark, sf):
    """Fit records as JSON text (layer 1 left out) and back."""
    from lumenfold import schemas
    a = areas(spark, sf)
    rec = F.struct(F.when(F.col("layer") != 1, F.col("layer")).alias("layer"), "region", F.col("area").alias("total_area"))
    text = a.groupBy("sample").agg(F.to_json(F.collect_list(rec)).alias("text"))  # regions x layers of one sample
    rows = text.select("sample", F.inline(F.from_json("text", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schemas.FIT_RESULT.split(', ') if c.split()[0] != 'sample')}>>")))
    return rows.select("sample", F.coalesce("layer", F.lit(1)).alias("layer"), "region", rnd("total_area", 2).alias("total_area"))


@query("source_format", r"""WITH f AS (SELECT doc_id AS id, ['csv', 'txt', 'vms', 'spe', 'xyz'][CAST(doc_id % 5 AS INTEGER) + 1] AS ext, text FROM documents UNION ALL SELECT -1 - page_id, 'dat', html FROM pages), h AS (SELECT *, substr(text, 1, 1000) AS s FROM f),
c AS (SELECT *, len(s) - len(replace(s, ',', '')) AS nc, len(s) - len(replace(s, chr(9), '')) AS nt, len(regexp_extract_all(s, '\b[A-Z][a-z]?\d[spdf]\b')) AS nr FROM h)
SELECT id, CASE WHEN ext = 'vms' THEN 'vamas' WHEN ext = 'spe' THEN 'spe' WHEN ext = 'xyz' THEN 'unknown' WHEN s LIKE '%VAMAS%' OR s LIKE '%Surface Chemical Analysis%' THEN 'vamas' WHEN greatest(nc, nt) > 20 AND nr > 1 THEN 'multi_region_csv' WHEN nc + nt > 0 THEN 'csv' ELSE 'ascii' END AS format FROM c""")
def source_format(spark, sf):
    e = F.element_at(F.array(*[F.lit(x) for x in ("csv", "txt", "vms", "spe", "xyz")]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), e.alias("ext"), "text")
    b = table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("id"), F.lit("dat").alias("ext"), F.col("html").alias("text"))
    return a.unionByName(b).select("id", tx.detect_format(F.col("ext"), F.col("text")).alias("format"))


@query("source_line_numbers", r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS s FROM documents) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(s, '[0-9]')) AS n_with_digits FROM l GROUP BY 1""")
def source_line_numbers(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(tx.lines_of(F.col("text"))).alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("s").rlike("[0-9]")).alias("n_with_digits"))


@query("source_tokens", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z][a-z]?\d[spdfSPDF]') THEN 1 ELSE 0 END AS has_token, len(regexp_extract_all(text, '[A-Za-z][a-z]?\d[spdfSPDF]')) AS n_tokens FROM documents""")
def source_tokens(spark, sf):
    from lumenfold.functions.scalars import region_token, region_token_count
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", region_token(t).isNotNull().cast("int").alias("has_token"), region_token_count(t).cast("bigint").alias("n_tokens"))


@query("source_marker", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'C1s' WHEN 1 THEN 'other' ELSE '-' END AS region FROM documents""")
def source_marker(spark, sf):
    r = F.pmod("doc_id", F.lit(3))
    path = F.when(r == 1, "/data/other.csv").otherwise("/data/aggregated_C1s_all.csv")
    first = F.when(r < 2, "# Combined Spectra Export").otherwise(F.substring("text", 1, 40))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(tx.aggregated_region(first, path), F.lit("-")).alias("region"))


@query("gate_files", """WITH f AS (SELECT doc_id, ['csv', 'txt', 'vms'][CAST(doc_id % 3 AS INTEGER) + 1] AS ext, octet_length(encode(CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END)) AS n FROM documents)
SELECT doc_id, n AS length, NOT (n < 100) AS accepted, (CASE WHEN n < 100 THEN 1 ELSE 0 END) + (CASE WHEN ext = 'txt' THEN 1 ELSE 0 END) AS n_issues FROM f""")
def gate_files(spark, sf):
    e = F.element_at(F.array(*[F.lit(x) for x in ("csv", "txt", "vms")]), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    raw = F.encode(F.when(F.pmod("doc_id", F.lit(11)) == 0, "").otherwise(F.col("text")), "UTF-8")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/data/f."), e).alias("path"), F.length(raw).cast("bigint").alias("length"),
                                             F.substring(raw, 1, 512).alias("header"))
    g = ql.gate_files(d)
    return g.select("doc_id", "length", "accepted", F.size("issues").alias("n_issues"))


TRIAGE = f"""{PTS}, g AS (SELECT instrument, sweep, count(*) AS n FROM pts GROUP BY 1, 2), ty AS (SELECT *, CASE instrument % 4
WHEN 0 THEN (CASE WHEN n >= 7 THEN 'depth_profile' WHEN n >= 5 THEN 'unknown' ELSE 'unknown' END) WHEN 1 THEN (CASE WHEN n >= 8 THEN 'standard' ELSE 'unknown' END)
WHEN 2 THEN 'standard' ELSE (CASE WHEN n >= 10 THEN 'standard' ELSE 'unknown' END) END AS data_type FROM g)"""


def triaged(spark, sf):
    """Depth CSV (12 cycles), two-column CSV, block files and free text, by instrument number."""
    p = packed(spark, sf)
    deep = F.concat(F.lit("sputter cycles\n"), F.array_join(F.zip_with("energy", "raw", lambda e, y: F.concat(e.cast("string"), F.repeat(F.concat(F.lit(","), y.cast("string")), F.lit(12)))), "\n"))
    r = F.pmod("instrument", F.lit(4))
    text = F.when(r == 0, deep).when(r == 1, F.concat(F.lit("header\n"), pairs_text())).when(r == 2, F.lit("VAMAS 1988")).otherwise(pairs_text(" "))
    ext = F.when(r <= 1, "csv").when(r == 2, "vms").otherwise("xy")
    return tx.triage(with_lines(p.withColumn("extension", ext), text).drop("region", "layer"))


@query("triage_files", f"""WITH {TRIAGE} SELECT instrument, CAST(sweep AS BIGINT) AS sweep, data_type, CASE data_type WHEN 'depth_profile' THEN 'map' WHEN 'standard' THEN 'standard' ELSE 'inspect' END AS route FROM ty""")
def triage_files(spark, sf):
    return triaged(spark, sf).select(*KEYS, "data_type", "route")


@query("triage_routing", f"""WITH {TRIAGE} SELECT count(*) AS n_files, count(*) FILTER (data_type = 'depth_profile') AS n_map, count(*) FILTER (data_type = 'standard') AS n_standard, count(*) FILTER (data_type = 'unknown') AS n_inspect, 'both' AS decision FROM ty""")
def triage_routing(spark, sf):
    return tx.routing(triaged(spark, sf))


@query("sink_matrix_view", f"WITH {MAP} SELECT y, " + ", ".join(f"round(max(CASE WHEN x = {k} AND c = 0 THEN v END), 6) + 0e0 AS x{k}" for k in range(25)) + " FROM mp GROUP BY 1")
def sink_matrix_view(spark, sf):
    m = map_spectra(spark, sf).select("y", "x", F.get("intensity", F.lit(0)).alias("value"))
    w = sk.matrix_view(m, 25)
    return w.select("y", *[rnd(f"x{k}", 6).alias(f"x{k}") for k in range(25)])


@query("sink_rounded", f"WITH {PTS} SELECT instrument, CAST(sweep AS BIGINT) AS sweep, i, round(intensity, 3) + 0e0 AS intensity FROM pts")
def sink_rounded(spark, sf):
    return sk.rounded(recorded_points(spark, sf).select(*KEYS, "i", "intensity"), 3).withColumn("intensity", F.col("intensity") + 0.0)
