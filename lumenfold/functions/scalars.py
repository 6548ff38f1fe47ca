"""Column-valued helpers shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column | str, digits: int) -> Column:
    """Round and turn -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def to_number(c: Column | str) -> Column:
    """Numeric coercion: bad text and NaN become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def clip(c: Column, lo: float, hi: float | None = None) -> Column:
    low = F.greatest(c, F.lit(float(lo)))
    return low if hi is None else F.least(low, F.lit(float(hi)))


# ---- names and labels -------------------------------------------------------

# Fixed value: an element symbol and an orbital.
REGION_TOKEN = r"[A-Za-z][a-z]?\d[spdfSPDF]"


def region_token(text: Column) -> Column:
    """First element-orbital token in canonical case (c1S -> C1s), NULL when absent."""
    return F.initcap(F.nullif(F.regexp_extract(text, REGION_TOKEN, 0), F.lit("")))


def region_token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(REGION_TOKEN))


def base_sample(name: Column, region: Column, layer: Column) -> Column:
    """Strip `_{region}_L{n}`, else `_{region}`, else keep the name."""
    tail_layer = F.concat(F.lit("_"), region, F.lit("_L"), layer.cast("string"))
    tail = F.concat(F.lit("_"), region)
    return (
        F.when(F.endswith(name, tail_layer), F.left(name, F.length(name) - F.length(tail_layer)))
        .when(F.endswith(name, tail), F.left(name, F.length(name) - F.length(tail)))
        .otherwise(name)
    )


# File extensions that are stripped from sample names.
KNOWN_EXTENSIONS = ("spe", "vgd", "npl", "xy", "txt", "asc", "dat", "csv", "vms", "vamas", "pro")


def strip_path_and_extension(path: Column) -> Column:
    name = F.regexp_replace(path, r"^.*[/\\]", "")
    bare = F.regexp_replace(name, r"(?i)\.(" + "|".join(KNOWN_EXTENSIONS) + ")$", "")
    return F.when(bare == "", path).otherwise(bare)


def safe_name(c: Column) -> Column:
    """Anything but letters, digits, dot, dash and underscore becomes `_`."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._\-]+", "_")


def sample_layer_label(base: Column, layer: Column) -> Column:
    return F.concat(base, F.lit("_L"), layer.cast("string"))


def element_of(region: Column) -> Column:
    """C1s -> C, Si2p -> Si."""
    return F.regexp_replace(region, r"\d[spdf].*$", "")


def pass_energy(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)pass\s*energy\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def numbers_in(text: Column) -> Column:
    """All numeric tokens of a line as ARRAY<DOUBLE>."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"), F.lit(1)),
        lambda t: t.try_cast("double"))


def run_tag(c: Column) -> Column:
    """Digits of a time stamp as yyyyMMddHHmmss; NULL when fewer than 14 digits."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) >= 14, F.substring(digits, 1, 14))


def natural_key(c: Column, width: int = 12) -> Column:
    """Sort key in which digit runs compare as numbers and letters without case."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(
        F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), width, "0"))
                    .otherwise(p)), "")


def column_key(name: str) -> str:
    """Column-name normalisation: drop dashes, brackets and blanks."""
    return "".join(ch for ch in name.strip() if ch not in "-() ")


# ---- rules ------------------------------------------------------------------

# Keywords per calibration mode, tried in this order.
CALIBRATION_KEYWORDS = (
    ("metallic_reference", ("foil", "au4f", "ag3d", "cu2p", "ir4f", "metallic ref")),
    ("fermi_edge", ("fermi", "valence", "conductor", "metal film")),
    ("disable", ("no calibration", "skip calibration", "disable")),
)


def calibration_mode(text: Column) -> Column:
    """Keyword rule from free text to a calibration mode."""
    t = F.lower(text)
    rule = F
    for mode, words in CALIBRATION_KEYWORDS:
        rule = rule.when(t.rlike("|".join(words)), mode)
    return rule.otherwise("adventitious_carbon")


def variability_band(mean_sigma: Column) -> Column:
    return F.when(mean_sigma < 10, "low").otherwise("sufficient")


def heterogeneity_band(entropy_sigma: Column) -> Column:
    return F.when(entropy_sigma < 0.3, "homogeneous").when(entropy_sigma < 0.8, "moderate").otherwise("heterogeneous")


def gate_alert(flag: Column, critical: Column, warnings: Column, issues: Column, first_message: Column,
               snr: Column) -> Column:
    """One line of text per severity."""
    return (
        F.when(critical > 0, F.format_string("critical: %d issues, first: %s", critical.cast("int"), first_message))
        .when(flag == "failed", F.format_string("failed: snr %.2f", snr))
        .when(flag == "poor", F.format_string("poor: snr %.2f, %d issues", snr, issues.cast("int")))
        .when(warnings > 0, F.format_string("%s: %d warnings, snr %.2f", flag, warnings.cast("int"), snr))
        .otherwise(F.format_string("%s: snr %.2f", flag, snr))
    )


# ---- line shapes ------------------------------------------------------------

def pseudo_voigt(x: Column, amp: Column, centre: Column, fwhm: Column, eta: Column) -> Column:
    """Height-normalised sum of a Lorentzian and a Gaussian of equal width."""
    w = F.greatest(fwhm, F.lit(1e-6))
    mix = F.least(F.greatest(eta, F.lit(0.0)), F.lit(1.0))
    t = x - centre
    half = w / F.lit(2.0)
    sigma = w / F.lit(2.0 * math.sqrt(2.0 * math.log(2.0)))
    lorentz = F.lit(1.0) / (F.lit(1.0) + (t / half) * (t / half))
    gauss = F.exp(-(t * t) / (F.lit(2.0) * sigma * sigma))
    return amp * (mix * lorentz + (F.lit(1.0) - mix) * gauss)


def gaussian_sum(x: Column, amps: Sequence[float], centres: Sequence[float], sigmas: Sequence[float],
                 shift: Column) -> Column:
    total = F.lit(0.0)
    for a, c, s in zip(amps, centres, sigmas):
        z = (x - F.lit(c) - shift) / F.lit(s)
        total = total + F.lit(a) * F.exp(F.lit(-0.5) * z * z)
    return total


def fermi_dirac(x: Column, amp: Column, edge: Column, width: Column, offset: Column) -> Column:
    return amp / (F.exp((x - edge) / width) + F.lit(1.0)) + offset


# ---- arrays (one packed spectrum per row) -----------------------------------

def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))


def l1_normalise(a: Column, eps: float = 1e-12) -> Column:
    total = F.greatest(F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v.cast("double"))), F.lit(eps))
    return F.transform(a, lambda v: v / total)


def l2_normalise(a: Column, eps: float = 1e-12) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))) + F.lit(eps)
    return F.transform(a, lambda v: v / norm)


def mean_normalise(a: Column, eps: float = 1e-12) -> Column:
    mean = array_sum(a) / F.size(a) + F.lit(eps)
    return F.transform(a, lambda v: v / mean)


def spectrum_entropy(a: Column, eps: float = 1e-12) -> Column:
    """Entropy of a spectrum read as a distribution."""
    total = F.greatest(array_sum(a), F.lit(eps))
    return -F.aggregate(a, F.lit(0.0), lambda s, v: s + (v / total) * F.ln(v / total + F.lit(eps)))


def rotate(a: Column, shift: Column) -> Column:
    """Cyclic shift to the right by `shift` places (negative: to the left)."""
    n = F.size(a)
    k = F.pmod(shift.cast("int"), n)
    return F.concat(F.slice(a, n - k + 1, k), F.slice(a, F.lit(1), n - k))
