"""Text formats as column expressions: a file is one row with its lines, and parsing needs no shuffle.

Each parser adds ARRAY<STRUCT<region, layer, i, energy, intensity>> to rows with ARRAY<STRING> lines; an empty array
means that the format was not recognised. A file's size bounds its row, and the file gate reports files beyond the limit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import fixed_values as fv
from lumenfold.functions.scalars import region_token, region_token_count
from lumenfold.operators.points import materialise

POINTS = "array<struct<region:string,layer:int,i:int,energy:double,intensity:double>>"


def read_files(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """(path, text) of all files under folders, globs or single paths; duplicates are read once."""
    wanted = sorted({paths} if isinstance(paths, str) else set(paths))
    if not wanted:
        raise ValueError("no input paths")
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(wanted).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_headers(spark: SparkSession, paths: str | Sequence[str], size: int = 512) -> DataFrame:
    """(path, length, header) for the file gate; the content column is cut before any shuffle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select("path", "length", F.expr(f"substring(content, 1, {size})").alias("header"))


def with_expected(headers: DataFrame, expected: DataFrame) -> DataFrame:
    """Add the expected paths that the scan did not return. Spark's scans skip files of zero bytes, so an absent
    file and an empty one both appear here with a NULL length, which the file gate treats as critical."""
    return expected.select("path").distinct().join(headers, "path", "full")


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "^﻿", ""), r"\r?\n")


def numbers(line: Column) -> Column:
    """Numeric fields of a line; other fields are skipped."""
    fields = F.split(F.trim(line), r"[,;\s]+")
    return F.filter(F.transform(fields, lambda t: t.try_cast("double")), lambda v: v.isNotNull())


def is_numeric(line: Column) -> Column:
    fields = F.filter(F.split(F.trim(line), r"[,\s]+"), lambda t: t != "")
    return (F.size(fields) > 0) & F.forall(fields, lambda t: t.try_cast("double").isNotNull())


def cells(line: Column) -> Column:
    return F.transform(F.split(line, ",", -1), lambda c: F.trim(c))


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    """0-based position of the first item that passes; -1 when none does."""
    return F.array_position(F.transform(items, lambda v: F.coalesce(test(v), F.lit(False))), F.lit(True)).cast("int") - 1


def _rows(pairs: Column, region: Column, layer: Column) -> Column:
    """ARRAY<STRUCT<e, y>> -> points."""
    return F.transform(pairs, lambda p, k: F.struct(
        region.cast("string").alias("region"), layer.cast("int").alias("layer"), k.alias("i"),
        p["e"].alias("energy"), p["y"].alias("intensity")))


def _pair(values: Column) -> Column:
    return F.struct(F.get(values, F.lit(0)).alias("e"), F.get(values, F.lit(1)).alias("y"))


def _up_to(first: Column, last: Column) -> Column:
    """first..last, empty when last < first (Spark's sequence would count down)."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


# ---- formats ----------------------------------------------------------------

def detect_format(extension: Column, text: Column) -> Column:
    """Extension first, then the first 1000 characters of text formats.

    The counts of separators and region tokens that decide are those of that stretch, so the stretch is part of the rule.
    """
    head = F.substring(text, 1, 1000)
    separators = F.greatest(F.regexp_count(head, F.lit("\t")), F.regexp_count(head, F.lit(",")))
    many = (separators > 20) & (F.regexp_count(head, F.lit(r"\b[A-Z][a-z]?\d[spdf]\b")) > 1)
    by_text = (F.when(head.rlike("VAMAS|Surface Chemical Analysis"), "vamas").when(many, "multi_region_csv")
               .when(head.rlike("[,\t]"), "csv").otherwise("ascii"))
    e = F.lower(extension)
    return (F.when(e.isin("vms", "vamas"), "vamas").when(e == "spe", "spe").when(e == "vgd", "vgd")
            .when(e.isin("txt", "asc", "csv", "dat"), by_text).otherwise("unknown"))


def prepared(files: DataFrame, lines: str = "lines") -> DataFrame:
    """Numeric fields and region token of every line, worked out once for all parsers."""
    if "_num" in files.columns:
        return files
    return materialise(files, _num=F.transform(lines, numbers), _tok=F.transform(lines, region_token))


def parse_two_column(files: DataFrame, lines: str = "lines", out: str = "points") -> DataFrame:
    """First two numeric fields per line; comment lines are skipped."""
    d = prepared(files, lines)
    kept = F.filter(F.zip_with(lines, "_num", lambda s, v: F.struct(F.ltrim(s).startswith("#").alias("c"), v.alias("v"))),
                    lambda p: ~p["c"] & (F.size(p["v"]) >= 2))
    return materialise(d, **{out: _rows(F.transform(kept, lambda p: _pair(p["v"])), F.lit(None), F.lit(1)).cast(POINTS)})


def _heads(lines: Column, flags: Column) -> Column:
    """ARRAY<STRUCT<at, end>>: flagged lines and the start of the next one."""
    n = F.size(lines)
    at = F.filter(F.transform(flags, lambda f, k: F.when(f, k)), lambda k: k.isNotNull())
    return F.transform(at, lambda k, q: F.struct(k.alias("at"), F.coalesce(F.get(at, q + 1), n).alias("end")))


def parse_sections(files: DataFrame, lines: str = "lines", out: str = "points") -> DataFrame:
    """Region token line, metadata lines, then energy/intensity lines until the next token or a line without both."""
    d = prepared(files, lines)
    flags = F.zip_with(lines, "_tok", lambda s, t: t.isNotNull() & ~F.ltrim(s).startswith("#"))
    d = materialise(d, _h=_heads(F.col(lines), flags))
    body = F.transform("_h", lambda h: F.struct(F.get("_tok", h["at"]).alias("region"), F.slice(
        "_num", h["at"] + 2, F.greatest(h["end"] - h["at"] - 1, F.lit(0))).alias("v")))
    d = materialise(d, _s=F.transform(body, lambda b: F.struct(b["region"].alias("region"), _leading_block(b["v"]).alias("v"))))
    kept = F.filter("_s", lambda b: F.size(b["v"]) >= 3)
    pts = F.flatten(F.transform(kept, lambda b: _rows(F.transform(b["v"], _pair), b["region"], F.lit(1))))
    return materialise(d, **{out: pts.cast(POINTS)}).drop("_h", "_s")


def _leading_block(rows: Column) -> Column:
    """Rows from the first one with two numbers up to the first one without."""
    good = F.transform(rows, lambda v: F.size(v) >= 2)
    start = F.array_position(good, True).cast("int")
    stop = F.array_position(F.slice(good, F.greatest(start, F.lit(1)), F.size(rows)), False).cast("int")
    return F.when(start > 0, F.slice(rows, start, F.when(stop > 0, stop - 1).otherwise(F.size(rows)))).otherwise(
        F.slice(rows, F.lit(1), F.lit(0)))


def parse_paired_rows(files: DataFrame, lines: str = "lines", out: str = "points") -> DataFrame:
    """Region line, energy row, intensity row of equal length >= 3 with monotone energies."""
    d = prepared(files, lines)
    d = materialise(d, _h=_heads(F.col(lines), F.transform("_tok", lambda t: t.isNotNull())))
    b = F.transform("_h", lambda h: F.struct(F.get("_tok", h["at"]).alias("region"), F.get("_num", h["at"] + 1).alias("e"),
                                             F.get("_num", h["at"] + 2).alias("y")))
    long = F.filter(b, lambda p: (F.size(p["e"]) >= 3) & (F.size(p["e"]) == F.size(p["y"])))
    d = materialise(d, _b=long)

    def monotone(p: Column) -> Column:
        ascending = F.array_sort(p["e"])
        return (p["e"] == ascending) | (p["e"] == F.reverse(ascending))

    pts = F.flatten(F.transform(F.filter("_b", monotone), lambda p: _rows(
        F.zip_with(p["e"], p["y"], lambda a, v: F.struct(a.alias("e"), v.alias("y"))), p["region"], F.lit(1))))
    return materialise(d, **{out: pts.cast(POINTS)}).drop("_h", "_b")


def _table(lines: Column) -> dict[str, Column]:
    """Header row of a column table (first row with two region tokens) and its column ranges."""
    rows = F.transform(lines, cells)
    # one pattern count per line; cells are only looked at where the line has two tokens
    head = first_where(F.zip_with(lines, rows, lambda s, r: F.when(region_token_count(s) >= 2, F.size(
        F.filter(r, lambda c: region_token(c).isNotNull())) >= 2).otherwise(False)), lambda b: b)
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return {"rows": rows, "head": head, "width": width}


def table_columns(head_cells: Column, width: Column) -> Column:
    """ARRAY<STRUCT<region, first, stop>> of the region columns; `stop` is the next region's column."""
    at = F.filter(_up_to(F.lit(0), F.size(head_cells) - 1), lambda k: region_token(F.get(head_cells, k)).isNotNull())
    return F.transform(at, lambda k, q: F.struct(region_token(F.get(head_cells, k)).alias("region"), k.alias("first"),
                                                 F.coalesce(F.get(at, q + 1), width).alias("stop")))


def _table_prepared(files: DataFrame, lines: str, after: int) -> DataFrame:
    t = _table(F.col(lines))
    d = materialise(files, _rows=t["rows"], _head=t["head"], _width=t["width"])
    d = d.withColumn("_cells", F.when(F.col("_head") >= 0, F.get("_rows", F.col("_head"))).otherwise(F.array().cast("array<string>")))
    return materialise(d, _cols=table_columns(F.col("_cells"), F.col("_width")), _data=F.slice(
        "_rows", F.greatest(F.col("_head"), F.lit(0)) + after, F.size("_rows")))


def parse_region_table(files: DataFrame, lines: str = "lines", out: str = "points") -> DataFrame:
    """Column table with replicates: the columns up to the next region header are averaged per row."""
    d = _table_prepared(files, lines, 2)

    def region(c: Column) -> Column:
        def row(r: Column) -> Column:
            values = F.filter(F.transform(F.slice(r, c["first"] + 2, F.greatest(c["stop"] - c["first"] - 1, F.lit(0))),
                                          lambda v: v.try_cast("double")), lambda v: v.isNotNull())
            mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)
            return F.struct(F.get(r, c["first"]).try_cast("double").alias("e"), F.when(F.size(values) > 0, mean).alias("y"),
                            F.array_max(values).alias("top"))

        kept = F.filter(F.transform("_data", row), lambda p: p["e"].isNotNull() & p["y"].isNotNull() & ~((p["e"] < 10) & (p["top"] < 10)))
        return F.when(F.size(kept) >= 3, _rows(kept, c["region"], F.lit(1)))

    pts = F.flatten(F.array_compact(F.transform("_cols", region))).cast(POINTS)
    return materialise(d, **{out: pts}).drop("_rows", "_head", "_width", "_cells", "_cols", "_data")


def parse_depth_table(files: DataFrame, lines: str = "lines", out: str = "points") -> DataFrame:
    """Depth table: header of region tokens, a row of layer numbers, then energy and one column per layer."""
    d = _table_prepared(files, lines, 3)
    labels = F.coalesce(F.get("_rows", F.col("_head") + 1), F.array().cast("array<string>"))
    d = materialise(d, _labels=labels)

    def region(c: Column) -> Column:
        here = F.slice("_labels", c["first"] + 2, F.greatest(c["stop"] - c["first"] - 1, F.lit(0)))
        layers = F.greatest(F.size(F.filter(here, lambda v: v.rlike(r"^\d+\.?\d*$"))), F.lit(1))

        def layer(n: Column) -> Column:
            pairs = F.transform("_data", lambda r: F.struct(F.get(r, c["first"]).try_cast("double").alias("e"),
                                                            F.get(r, c["first"] + n).try_cast("double").alias("y")))
            kept = F.filter(pairs, lambda p: p["e"].isNotNull() & p["y"].isNotNull())
            return F.when(F.size(kept) >= 3, _rows(kept, c["region"], n))

        return F.flatten(F.array_compact(F.transform(F.sequence(F.lit(1), layers), layer)))

    pts = F.flatten(F.transform("_cols", region)).cast(POINTS)
    return materialise(d, **{out: pts}).drop("_rows", "_head", "_width", "_cells", "_cols", "_data", "_labels")


# Fixed value: the title of a labelled block, with region and number.
BLOCK_HEAD = r"^\s*([A-Za-z][a-z]?\s*\d[spdfSPDF]|(?i:survey)|VB|Auger)\s*/\s*(\d+)"


def parse_blocks(files: DataFrame, lines: str = "lines") -> DataFrame:
    """Labelled blocks (`C 1s/7`): one row per block with region, number, pass energy and its points.

    A block holds metadata lines, a line with the number of points, then that many energy/intensity lines. The number
    is the first whole number on a line of its own that is followed by as many data lines, of whatever count. A block
    without one has status `count_mismatch` and no points; others have `ok`.
    """
    heads = materialise(files, _h=_heads(F.col(lines), F.transform(lines, lambda s: s.rlike(BLOCK_HEAD))))
    b = heads.withColumn("_b", F.explode("_h"))
    b = materialise(b, _title=F.get(lines, F.col("_b.at")), _body=F.slice(lines, F.col("_b.at") + 2, F.greatest(
        F.col("_b.end") - F.col("_b.at") - 1, F.lit(0))))
    b = materialise(b, _whole=F.transform("_body", lambda s: F.trim(s).rlike(r"^\d+$")), _n=F.transform("_body", numbers))
    places = F.filter(F.transform("_whole", lambda v, k: F.when(v, k)), lambda k: k.isNotNull())
    after = lambda k: F.size(F.filter(F.slice("_n", k + 2, F.size("_n")), lambda v: F.size(v) >= 2))
    fits = F.filter(places, lambda k: F.trim(F.get("_body", k)).try_cast("int") == after(k))
    b = materialise(b, _at=F.coalesce(F.get(fits, F.lit(0)), F.lit(-1)))
    count = F.trim(F.get("_body", F.col("_at"))).try_cast("int")
    data = F.filter(F.slice("_n", F.col("_at") + 2, F.size("_n")), lambda v: F.size(v) >= 2)
    pe = F.regexp_extract(F.array_join(F.slice("_body", F.lit(1), F.greatest(F.col("_at"), F.lit(0))), "\n"),
                          r"(?i)pass[_ ]?energy[\s=:]+([0-9]+(?:\.[0-9]*)?)", 1).try_cast("double")
    b = materialise(b, _pairs=F.when(F.col("_at") >= 0, F.slice(F.transform(data, _pair), F.lit(1), count)))
    name = F.regexp_replace(F.regexp_extract("_title", BLOCK_HEAD, 1), r"\s+", "")
    keep = [c for c in files.columns if c not in (lines, "text")]
    none = F.array().cast("array<struct<e: double, y: double>>")
    b = b.withColumn("status", F.when(F.col("_at") >= 0, "ok").otherwise("count_mismatch"))
    b = b.withColumn("_pairs", F.coalesce("_pairs", none))
    return b.select(
        *keep, F.coalesce(region_token(name), name).alias("region"),
        F.regexp_extract("_title", BLOCK_HEAD, 2).try_cast("int").alias("block"), pe.alias("pass_energy"),
        F.transform("_pairs", lambda p: p["e"]).alias("energy"), F.transform("_pairs", lambda p: p["y"]).alias("intensity"), "status")


def to_binding(energy: Column, kinetic: Column, photon_ev: float = fv.PHOTON_ENERGY_EV) -> Column:
    """Packed energies to binding energy where the scale is stated to be kinetic."""
    return F.when(kinetic, F.transform(energy, lambda e: F.lit(photon_ev) - e)).otherwise(energy)


# ---- maps -------------------------------------------------------------------

def header_dims(lines: Column) -> Column:
    """STRUCT(nx, ny), each as named first in the text; NULL unless both are there."""
    def value(names: str) -> Column:
        # Fixed value: how a header names a dimension.
        pattern = rf"(?i)(?:^|\b)(?:{names})\s*[:=]\s*(\d+)"
        hits = F.filter(F.transform(lines, lambda s: F.regexp_extract(s, pattern, 1)), lambda v: v != "")
        return F.get(hits, F.lit(0)).try_cast("int")

    nx, ny = value(r"nx|X\s*(?:size|points|pixels)|Width"), value(r"ny|Y\s*(?:size|points|pixels)|Height")
    return F.when(nx.isNotNull() & ny.isNotNull(), F.struct(nx.alias("nx"), ny.alias("ny")))


def count_map_rows(lines: Column) -> Column:
    """Lines as wide as the first line with at least five numbers, that line not counted; NULL when none."""
    sizes = F.transform(lines, lambda s: F.size(numbers(s)))
    at = first_where(sizes, lambda n: n >= 5)
    n = F.size(F.filter(F.slice(sizes, F.greatest(at, F.lit(0)) + 2, F.size(sizes)), lambda v: v == F.get(sizes, at)))
    return F.when((at >= 0) & (n > 0), n)


def parse_maps(files: DataFrame, lines: str = "lines", regions: dict | None = None, nx: int | None = None,
               ny: int | None = None) -> DataFrame:
    """Map text: region line, six scalars, optional energy comment and axis row, one row of intensities per pixel.

    Result: one row per file with region, scalars, energy and `rows` (only the rows that are present).
    """
    regions = regions or fv.REGION_DEFINITIONS
    clean = F.filter(F.transform(F.col(lines), lambda s: F.trim(s)), lambda s: s != "")
    d = materialise(files, _l=clean)
    known = F.array(*[F.lit(r.lower()) for r in regions])
    exact = first_where(F.col("_l"), lambda s: F.array_contains(known, F.lower(F.regexp_replace(s, "[^A-Za-z0-9]", ""))))
    loose = first_where(F.col("_l"), lambda s: ~is_numeric(s) & ~s.rlike(r"\b\d{1,2}[-/](?:[A-Za-z]{3}|\d{1,2})\b"))
    d = materialise(d, _r=F.when(exact >= 0, exact).otherwise(loose)).filter("_r >= 0")
    d = materialise(d, _n=F.transform("_l", numbers))
    # the scalars may be spread over several lines: walk on until six were seen
    walk = F.aggregate(
        F.slice("_n", F.col("_r") + 2, F.size("_n")), F.struct(F.lit(0).alias("seen"), (F.col("_r") + 1).alias("j")),
        lambda s, v: F.when(s["seen"] < 6, F.struct((s["seen"] + F.size(v)).alias("seen"), (s["j"] + 1).alias("j"))).otherwise(s))
    d = materialise(d, _w=walk).filter("_w.seen >= 6")
    scalars = F.flatten(F.slice("_n", F.col("_r") + 2, F.col("_w.j") - F.col("_r") - 1))
    d = materialise(d, _s=scalars, _j=F.col("_w.j"))
    hint = first_where(F.slice("_l", F.col("_j") + 1, F.size("_l")), lambda s: s.startswith("#") & s.rlike("(?i)energy"))

    def axis_line(k: Column) -> Column:
        v = F.get("_n", k)
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
        return is_numeric(F.get("_l", k)) & (F.size(v) >= 5) & (mean > 40) & (mean < 1200)

    after = _up_to(F.col("_j") + hint, F.size("_l") - 1)
    axis = F.when(hint >= 0, F.get(F.filter(after, axis_line), F.lit(0)))
    data = F.get(F.filter(_up_to(F.col("_j"), F.size("_l") - 1), lambda k: is_numeric(F.get("_l", k))), F.lit(0))
    d = materialise(d, _axis=axis, _first=F.when(axis.isNotNull(), axis + 1).otherwise(data)).filter("_first IS NOT NULL")
    width = F.size(F.get("_n", F.coalesce("_axis", "_first")))
    body = F.filter(F.zip_with(F.slice("_l", F.col("_first") + 1, F.size("_l")), F.slice("_n", F.col("_first") + 1, F.size("_n")),
                               lambda s, v: F.struct(s.alias("s"), v.alias("v"))),
                    lambda p: ~p["s"].startswith("#") & (F.size(p["v"]) > 0))
    d = materialise(d, _p=F.transform(body, lambda p: p["v"]), _width=width)
    stop = first_where(F.col("_p"), lambda v: F.size(v) != F.col("_width"))
    d = materialise(d, _rows=F.when(stop >= 0, F.slice("_p", F.lit(1), stop)).otherwise(F.col("_p")))
    token = F.lower(F.regexp_replace(F.get("_l", F.col("_r")), "[^A-Za-z0-9]", ""))
    canon = F.create_map(*[F.lit(v) for r in regions for v in (r.lower(), r)])
    name = F.coalesce(F.try_element_at(canon, token), F.get("_l", F.col("_r")))
    lo = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for r, t in regions.items() for v in (r, float(t[0]))]), name), F.lit(50.0))
    hi = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for r, t in regions.items() for v in (r, float(t[1]))]), name), F.lit(300.0))
    from lumenfold.operators.resample import linear_axis
    made = linear_axis(lo, hi, F.col("_width"))
    keep = [c for c in files.columns if c not in (lines, "text")]
    s = [F.get("_s", F.lit(k)) for k in range(6)]
    return d.select(
        *keep, name.alias("region"), s[0].alias("x0"), s[1].alias("dx"), (F.lit(nx) if nx else F.round(s[2])).cast("int").alias("nx"),
        s[3].alias("y0"), s[4].alias("dy"), (F.lit(ny) if ny else F.round(s[5])).cast("int").alias("ny"),
        F.when(F.col("_axis").isNotNull(), F.get("_n", F.col("_axis"))).otherwise(made).alias("energy"), F.col("_rows").alias("rows"))


def map_pixels_of(maps: DataFrame) -> DataFrame:
    """One row per pixel; missing pixels are zero spectra."""
    total = F.col("nx") * F.col("ny")
    zeros = F.transform("energy", lambda e: F.lit(0.0))
    full = F.transform(_up_to(F.lit(0), total - 1), lambda k: F.coalesce(F.get("rows", k), zeros))
    keep = [c for c in maps.columns if c not in ("rows", "energy", "x0", "dx", "y0", "dy")]
    d = maps.select(*keep, F.posexplode(full).alias("_k", "intensity"))
    return d.withColumn("y", F.floor(F.col("_k") / F.col("nx")).cast("int")).withColumn(
        "x", F.pmod("_k", "nx").cast("int")).drop("_k")


# ---- concentration tables ---------------------------------------------------

def parse_concentrations(files: DataFrame, lines: str = "lines") -> DataFrame:
    """Rows of the concentration section in long form: sample, layer (row number), element, percent.

    Mean, deviation and factor rows, dashes and blanks are skipped; the section ends at the weight table.
    """
    name = F.get(F.filter(lines, lambda s: F.ltrim(s).startswith("File Name")), F.lit(0))
    sample = F.coalesce(F.regexp_replace(F.trim(F.regexp_replace(name, r"^[^:]*:", "")), '"', ""), F.lit("unknown"))
    start = first_where(F.col(lines), lambda s: s.rlike(r"(?i)\bAtomic Concentration Table\b"))
    d = materialise(files, sample=sample, _start=start).filter("_start >= 0")
    body = F.slice(lines, F.col("_start") + 2, F.size(lines))
    stop = first_where(body, lambda s: s.rlike(r"(?i)\bWeight % Table\b"))
    d = materialise(d, _b=F.filter(F.when(stop >= 0, F.slice(body, F.lit(1), stop)).otherwise(body), lambda s: ~s.rlike(r"^[-\s]*$")))
    head = first_where(F.col("_b"), lambda s: F.forall(F.split(F.trim(s), r"\s+"), lambda t: t.rlike(r"[A-Za-z]") & t.rlike(r"\d")))
    d = materialise(d, _h=head).filter("_h >= 0")
    d = materialise(d, _names=F.split(F.trim(F.get("_b", F.col("_h"))), r"\s+"))
    rows = F.filter(F.slice("_b", F.col("_h") + 2, F.size("_b")), lambda s: ~s.rlike(r"(?i)\bMean\b|Standard\s+Deviation|Std\.?\s*Dev|\b(RSF|CorrectedRSF)\b"))
    values = F.filter(F.transform(rows, lambda s: F.regexp_extract_all(s, F.lit(r"([-+]?(?:\d*\.\d+|\d+))"), F.lit(1))),
                      lambda v: F.size(v) >= F.size("_names"))
    keep = [c for c in files.columns if c not in (lines, "text", "sample")]
    r = d.select(*keep, "sample", "_names", F.posexplode(values).alias("_k", "_v"))
    z = r.select(*keep, "sample", (F.col("_k") + 1).alias("layer"), F.posexplode("_names").alias("_c", "element"), "_v")
    return z.select(*keep, "sample", "layer", "element", F.get("_v", F.col("_c")).try_cast("double").alias("percent"))


# ---- choice of parser, triage -----------------------------------------------

def parse_files(files: DataFrame, lines: str = "lines") -> DataFrame:
    """The first parser in this order that yields points wins; `parser` is NULL for files nobody can read.

    Once a parser has won, the later ones see a file without lines, so each file is parsed as far as its winner only.
    """
    d = prepared(files, lines).withColumn("_all", F.col(lines))
    order = [("depth_table", "_p1", parse_depth_table, F.exists("_p1", lambda p: p["layer"] > 1)),
             ("region_table", "_p2", parse_region_table, F.size("_p2") > 0), ("paired_rows", "_p3", parse_paired_rows, F.size("_p3") > 0),
             ("sections", "_p4", parse_sections, F.size("_p4") > 0), ("two_column", "_p5", parse_two_column, F.size("_p5") > 0)]
    name, pts = F, F
    for n, c, parser, ok in order:
        d = parser(d, lines, c)
        name, pts = name.when(ok, n), pts.when(ok, F.col(c))
        d = materialise(d, **{k: F.when(ok, F.slice(k, 1, 0)).otherwise(F.col(k)) for k in (lines, "_num", "_tok")})
    d = d.withColumn(lines, F.col("_all")).drop("_all")
    d = materialise(d, parser=name.otherwise(None), points=pts.otherwise(F.array().cast(POINTS)))
    return d.drop("_p1", "_p2", "_p3", "_p4", "_p5", "_num", "_tok")


def explode_points(parsed: DataFrame, points: str = "points") -> DataFrame:
    keep = [c for c in parsed.columns if c not in (points, "lines", "text") and not c.startswith("_")]
    return parsed.select(*keep, F.inline(points))


def aggregated_region(first_line: Column, path: Column) -> Column:
    """Region of a combined export (marker in the first line), from the file name; NULL for other files."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    named = F.regexp_extract(stem, r"(?i)^aggregated_([A-Za-z][A-Za-z0-9]*)(?:_.*)?$", 1)
    return F.when(F.contains(first_line, F.lit("# Combined Spectra Export")), F.when(named != "", named).otherwise(stem))


def unpivot_aggregated(wide: DataFrame, energy: str = "Binding_Energy_eV", min_points: int = 5) -> DataFrame:
    """Combined export: one spectrum per `Intensity_*` or `*_cps` column; non-finite values and short ones drop out."""
    from lumenfold.functions.scalars import to_number
    values = [c for c in wide.columns if c.startswith("Intensity_") or c.endswith("_cps")]
    if not values:
        raise ValueError("no intensity columns")
    keys = [c for c in wide.columns if c not in values and c != energy]
    num = wide.select(*keys, to_number(F.col(energy)).alias("energy"), *[to_number(F.col(c)).alias(c) for c in values])
    long = num.unpivot([*keys, "energy"], values, "column", "intensity").filter(F.col("energy").isNotNull() & F.col("intensity").isNotNull())
    label = F.regexp_replace(F.regexp_replace("column", "^Intensity_", ""), "_cps$", "")
    layer = F.regexp_extract("column", r"_L(\d+)(?:_|$)", 1).try_cast("int")
    long = long.select(*keys, label.alias("label"), layer.alias("layer"), "energy", "intensity")
    enough = long.groupBy(*keys, "label").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_points).drop("_n")
    return long.join(enough, [*keys, "label"], "left_semi")


# Words in the header of a depth profile; names that mark a region line.
DEPTH_WORDS = ("sputter", "cycle", "layer", "depth", "etch", "profile")
REGION_WORDS = ("C1s", "C2s", "O1s", "N1s", "F1s", "Si2p", "P2p", "S2p", "survey", "wide")


def triage(files: DataFrame, extension: str = "extension", lines: str = "lines", many_cycles: int = 10) -> DataFrame:
    """Add data_type, confidence and route from structure scores of each file.

    A depth profile needs at least two cycles; with more than `many_cycles` it goes the map way.
    """
    full = F.filter(lines, lambda s: F.trim(s) != "")
    d = materialise(files, _l=full)
    d = materialise(d, _n=F.transform("_l", numbers), _num=F.transform("_l", lambda s: F.contains(s, F.lit(",")) & is_numeric(s)))
    k = F.size("_l")
    table = first_where(F.zip_with("_num", "_n", lambda a, v: a & (F.size(v) >= 2)), lambda b: b)
    d = materialise(d, _head=F.when(table >= 0, F.slice("_l", 1, table)).otherwise(F.col("_l")))  # all before the first data line
    head = F.col("_head")
    region = F.exists(head, lambda s: s.rlike("(?i)" + "|".join(REGION_WORDS)))
    words = F.lower(F.array_join(head, " ")).rlike("|".join(DEPTH_WORDS))
    lone = F.filter(F.transform(head, lambda s: F.trim(s).try_cast("double")), lambda v: v.isNotNull())
    nx, ny = F.get(lone, F.lit(2)), F.get(lone, F.lit(5))
    spatial = (F.size(lone) >= 6) & nx.between(1, 5000) & ny.between(1, 5000) & (nx == F.floor(nx)) & (ny == F.floor(ny))
    start = first_where(F.zip_with("_num", "_n", lambda a, v: a & (F.size(v) >= 2)), lambda b: b)
    d = materialise(d, _region=region, _words=words, _spatial=F.coalesce(spatial, F.lit(False)), _pixels=nx * ny, _start=start)
    data = F.slice("_n", F.greatest(F.col("_start"), F.lit(0)) + 1, F.size("_n"))
    d = materialise(d, _data=data, _cols=F.when(F.col("_start") >= 0, F.size(F.get("_n", F.col("_start")))).otherwise(0))
    first = F.transform("_data", lambda v: F.get(v, F.lit(0)))
    steps = F.transform(F.slice(first, F.lit(2), F.greatest(F.size(first) - 1, F.lit(0))), lambda v, q: v - F.get(first, q))
    up, down = F.size(F.filter(steps, lambda s: s > 0)), F.size(F.filter(steps, lambda s: s < 0))
    ordered = (F.size(first) >= 5) & (F.greatest(up, down) >= 0.7 * F.size(steps))
    even = F.forall("_data", lambda v: F.size(v) == F.col("_cols"))
    usable = (k >= 8) & (F.col("_start") >= 0) & (F.size("_data") >= 5) & (F.col("_cols") >= 2)

    def score(flag: Column, value: float) -> Column:
        return F.when(flag, F.lit(value)).otherwise(0.0)

    base = score(F.col("_region"), 0.2) + score(F.col("_words"), 0.2) + score(ordered, 0.3) + score(even, 0.2)
    depth = F.when(usable, F.when(F.col("_spatial"), F.greatest(base - 0.5, F.lit(0.0))).otherwise(base + 0.1)).otherwise(0.0)
    axis = first_where(F.zip_with("_num", "_n", lambda a, v: a & (F.size(v) >= 6) & F.forall(v, lambda x: x.between(-50, 5000)) & (
        F.size(F.filter(F.transform(F.slice(v, F.lit(2), F.size(v) - 1), lambda x, q: x - F.get(v, q)), lambda s: s >= 0)) >= 0.8 * (F.size(v) - 1))),
        lambda b: b)
    d = materialise(d, _depth=F.round(depth, 6), _axis=axis)
    rest = k - F.col("_axis") - 1
    fits = F.col("_spatial") & (F.col("_axis") >= 0) & (F.abs(rest - F.col("_pixels")) <= F.greatest(F.lit(1.0), 0.1 * F.col("_pixels")))
    grid = F.when(k >= 8, score(F.col("_region"), 0.25) + score(F.col("_spatial"), 0.4) + score(F.col("_axis") >= 0, 0.3) + score(fits, 0.1)).otherwise(0.0)
    pairs = F.size(F.filter(F.zip_with("_l", "_n", lambda s, v: s.rlike("[,\t]") & (F.size(v) >= 2)), lambda b: b))
    spaced = F.size(F.filter("_n", lambda v: F.size(v) >= 2))
    d = materialise(d, _map=F.round(grid, 6), _pairs=pairs, _spaced=spaced)
    e, cycles = F.lower(F.col(extension)), F.col("_cols") - 1
    csv_type = (F.when((F.col("_depth") > 0.6) & (cycles >= 2), "depth_profile").when(F.col("_map") > 0.7, "map_hyperspectral")
                .when(F.col("_map") > 0.6, "map_2d").when(F.col("_pairs") >= 8, "standard").otherwise("unknown"))
    csv_score = (F.when(csv_type == "depth_profile", F.least(F.col("_depth"), F.lit(0.95)))
                 .when(csv_type.startswith("map"), F.least(F.col("_map"), F.lit(0.95))).when(csv_type == "standard", 0.7).otherwise(0.0))
    text_ok = F.col("_spaced") >= 10
    kind = (F.when(e == "csv", csv_type).when(e.isin("vms", "vamas", "spe", "vgd", "npl", "pro"), "standard")
            .when(e.isin("xy", "txt", "asc", "dat") & text_ok, "standard").otherwise("unknown"))
    conf = (F.when(e == "csv", csv_score)
            .when(e.isin("vms", "vamas"), F.when(F.get("_l", F.lit(0)).rlike("(?i)VAMAS|^ISO"), 0.9).otherwise(0.7))
            .when(e.isin("spe", "vgd", "npl", "pro"), 0.9).when(e.isin("xy", "txt", "asc", "dat"), F.when(text_ok, 0.85).otherwise(0.3)).otherwise(0.0))
    d = materialise(d, data_type=kind, confidence=conf, n_cycles=F.greatest(cycles, F.lit(0)))
    route = (F.when(F.col("data_type").startswith("map"), "map").when(
        (F.col("data_type") == "depth_profile") & (F.col("n_cycles") > many_cycles), "map")
        .when(F.col("data_type") == "unknown", "inspect").otherwise("standard"))
    return d.withColumn("route", route).drop(*[c for c in d.columns if c.startswith("_")])


def routing(triaged: DataFrame) -> DataFrame:
    """Counts per type and the overall decision: map, standard, both or none."""
    g = triaged.agg(F.count("*").alias("n_files"), F.count_if(F.col("route") == "map").alias("n_map"),
                    F.count_if(F.col("route") == "standard").alias("n_standard"), F.count_if(F.col("route") == "inspect").alias("n_inspect"))
    m, s = F.col("n_map") > 0, F.col("n_standard") > 0
    return g.withColumn("decision", F.when(m & s, "both").when(m, "map").when(s, "standard").otherwise("none"))
