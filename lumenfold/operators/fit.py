"""Bounded least-squares fits of packed spectra: templates of pseudo-Voigt lines, Gaussians, edges.

A template is compiled once on the driver into a parameter map with bounds. Spectra are fitted in Arrow batches,
all rows of a batch that share a template at the same time, wherever they happen to be: nothing is regrouped by
region, so a region that owns most spectra does not make a hot partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.scalars import pseudo_voigt
from lumenfold.operators.background import shirley_packed
from lumenfold.operators.peaks import FWHM_PER_SIGMA, find_peaks
from lumenfold.operators.points import along, materialise
from lumenfold.operators.smooth import savgol
from lumenfold.session import spread

PARAMETERS = ("amplitude", "binding_energy", "fwhm", "eta")
# Bounds that a template may leave out (initial, low, high).
DEFAULT_BOUNDS = {"amplitude": (None, 0.0, 1e9), "binding_energy": (None, None, None), "fwhm": (None, 0.9, 2.2),
                  "eta": (0.30, 0.25, 0.40)}


@dataclass
class Bound:
    init: float | None
    lo: float
    hi: float
    master: str | None = None
    ratio: float = 1.0


@dataclass
class Line:
    name: str
    amplitude: Bound
    binding_energy: Bound
    fwhm: Bound
    eta: Bound


@dataclass
class RegionTemplate:
    template: str
    region: str
    lo: float
    hi: float
    lines: list[Line]
    background: str = "shirley"
    fwhm_rule: str = ""
    tolerance: float = 0.0


def _bound(raw: dict | None, kind: str) -> Bound:
    raw = raw or {}
    d_init, d_lo, d_hi = DEFAULT_BOUNDS[kind]
    init = raw.get("initial_guess", raw.get("initial", d_init))
    lo, hi = raw.get("min_bound", raw.get("min", d_lo)), raw.get("max_bound", raw.get("max", d_hi))
    if lo is None or hi is None:
        raise ValueError(f"{kind} needs bounds")
    lo, hi = float(lo), float(hi)
    if kind == "fwhm" and lo <= 0:
        lo = 0.05
    if lo > hi and kind != "amplitude":
        lo, hi = hi, lo
    master = raw.get("constraint_to") if raw.get("is_constrained") else None
    return Bound(None if init is None else float(init), lo, hi, master, float(raw.get("constraint_ratio", 1.0)))


def parse_template(raw: dict) -> list[RegionTemplate]:
    """Template document (already read from YAML) -> regions; disabled components are dropped."""
    out = []
    for r in raw.get("regions", []):
        span = r.get("fit_range_ev", r.get("energy_range"))
        if span is None or len(span) != 2:
            raise ValueError("region without an energy range")
        rule = r.get("fwhm_constraint") or {}
        lines = [Line(c.get("name", "component"), _bound(c.get("amplitude"), "amplitude"),
                      _bound(c.get("binding_energy"), "binding_energy"), _bound(c.get("fwhm"), "fwhm"),
                      _bound(c.get("pseudo_voigt_mix"), "eta"))
                 for c in r.get("components", []) if c.get("enabled", True)]
        out.append(RegionTemplate(raw.get("template_name", ""), r.get("element", r.get("name", "")), float(min(span)),
                                  float(max(span)), lines, str(r.get("background_type", "shirley")).lower().strip(),
                                  str(rule.get("type") or "").lower().strip(), float(rule.get("tol", 0.0))))
    return out


@dataclass
class Compiled:
    """Free vector of a region: start, bounds and where each line finds its four parameters."""

    region: RegionTemplate
    start: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    amp: list[tuple[int, float]]
    centre: list[int]
    width: list[tuple[int, int]]  # (base, relative change or -1)
    mix: list[int]
    own_amp: list[int] = field(default_factory=list)  # lines with a free amplitude


def compile_template(t: RegionTemplate) -> Compiled:
    start, lo, hi = [], [], []

    def free(value: float | None, a: float, b: float) -> int:
        start.append(float(np.clip((a + b) / 2.0 if value is None else value, a, b)))
        lo.append(a)
        hi.append(b)
        return len(start) - 1

    names = [ln.name for ln in t.lines]
    amp, centre, own = {}, [], []
    for n, ln in enumerate(t.lines):
        m = ln.amplitude.master
        if m in amp and amp[m][1] == 1.0:
            amp[ln.name] = (amp[m][0], ln.amplitude.ratio)
        else:
            amp[ln.name] = (free(ln.amplitude.init, ln.amplitude.lo, ln.amplitude.hi), 1.0)
            own.append(n)
        centre.append(free(ln.binding_energy.init, ln.binding_energy.lo, ln.binding_energy.hi))

    def leader(b: Bound, name: str) -> str:
        return b.master if b.master in names and b.master != name else name

    width: dict[str, tuple[int, int]] = {}

    def single(ln: Line) -> None:
        width[ln.name] = (free(ln.fwhm.init, ln.fwhm.lo, ln.fwhm.hi), -1)

    if t.fwhm_rule == "uniform":
        groups = {"": t.lines}
    elif t.fwhm_rule == "tolerance":
        groups = {}
        for ln in t.lines:
            groups.setdefault(leader(ln.fwhm, ln.name), []).append(ln)
    else:
        groups = {ln.name: [ln] for ln in t.lines}
        for ln in t.lines:
            single(ln)
    tol = min(max(t.tolerance, 0.0), 0.95) if t.fwhm_rule == "tolerance" else 0.0
    if not width:
        for members in groups.values():
            a, b = max(ln.fwhm.lo for ln in members), min(ln.fwhm.hi for ln in members)
            if not a + 1e-8 < b:  # no common width: every line keeps its own
                for ln in members:
                    single(ln)
                continue
            guess = [(ln.fwhm.lo + ln.fwhm.hi) / 2 if ln.fwhm.init is None else np.clip(ln.fwhm.init, ln.fwhm.lo, ln.fwhm.hi)
                     for ln in members]
            base = free(float(np.mean(guess)), a, b)
            for ln in members:
                d_lo, d_hi = max(-tol, ln.fwhm.lo / b - 1.0, -0.95), min(tol, ln.fwhm.hi / a - 1.0)
                width[ln.name] = (base, free(0.0, d_lo, d_hi) if d_hi - d_lo >= 1e-6 else -1)

    mix: dict[str, int] = {}
    shared: dict[str, int] = {}
    for ln in t.lines:
        key = leader(ln.eta, ln.name)
        if key in shared:
            k = shared[key]
            lo[k], hi[k] = max(lo[k], ln.eta.lo), min(hi[k], ln.eta.hi)
            if lo[k] > hi[k]:
                raise ValueError(f"no common mixing range for {key}")
            start[k] = float(np.clip(start[k], lo[k], hi[k]))
        else:
            shared[key] = free(ln.eta.init, ln.eta.lo, ln.eta.hi)
        mix[ln.name] = shared[key]
    return Compiled(t, np.array(start), np.array(lo), np.array(hi), [amp[n] for n in names], centre,
                    [width[n] for n in names], [mix[n] for n in names], own)


def initial_peaks(templates: Sequence[RegionTemplate], region: str) -> list[tuple[float, float]]:
    """(centre, sigma) of a region's lines, by exact name, then without case; sigma is fwhm / 2.355."""
    hit = [t for t in templates if t.region == region] or [t for t in templates if t.region.lower() == region.lower()]
    out = []
    for ln in hit[0].lines if hit else []:
        b, w = ln.binding_energy, ln.fwhm
        out.append(((b.lo + b.hi) / 2 if b.init is None else b.init, ((w.lo + w.hi) / 2 if w.init is None else w.init) / 2.355))
    return out


# ---- batched bounded least squares ------------------------------------------

Model = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


#: Derivatives of the rows that are fitted at once, at most.
SLICE_BYTES = 4 << 20


def bounded_lm(model: Model, theta: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, y: np.ndarray,
               weight: np.ndarray, steps: int = 200, tol: float = 1e-10, ended: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Damped least squares of many rows at once; every row has its own damping, bounds and stop.

    `ended`, if given, is set where a row stopped by itself and not after `steps` steps. Rows are taken in slices whose
    derivatives fill at most SLICE_BYTES, so the memory does not grow with the rows of a batch.
    """
    size = max(1, SLICE_BYTES // (8 * max(1, x.shape[1] * theta.shape[1])))
    if len(theta) > size:
        parts = []
        for begin in range(0, len(theta), size):
            at = slice(begin, begin + size)
            parts.append(bounded_lm(model, theta[at], lo[at], hi[at], x[at], y[at], weight[at], steps, tol, None if ended is None else ended[at]))
        return np.concatenate([t for t, _ in parts]), np.concatenate([q for _, q in parts])
    theta = np.clip(theta, lo, hi)
    f, jac = model(theta, x)
    res = (y - f) * weight
    ss = (res * res).sum(1)
    lam = np.full(len(theta), 1e-2)
    live = np.arange(len(theta))
    eye = np.eye(theta.shape[1])
    for _ in range(steps):
        if live.size == 0:
            break
        j = jac[live] * weight[live, :, None]
        grad = np.einsum("rnp,rn->rp", j, res[live])
        held = ((theta[live] <= lo[live]) & (grad < 0)) | ((theta[live] >= hi[live]) & (grad > 0))
        grad[held] = 0.0
        j = np.where(held[:, None, :], 0.0, j)
        normal = np.einsum("rnp,rnq->rpq", j, j)
        scale = np.einsum("rpp->rp", normal)
        scale = np.maximum(scale, 1e-12 * scale.max(1, keepdims=True) + 1e-30)
        normal = normal + (lam[live, None] * scale + held)[:, :, None] * eye
        move = np.linalg.solve(normal, grad[:, :, None])[:, :, 0]
        trial = np.clip(theta[live] + move, lo[live], hi[live])
        f2, j2 = model(trial, x[live])
        r2 = (y[live] - f2) * weight[live]
        s2 = (r2 * r2).sum(1)
        better = s2 < ss[live]
        gain = (ss[live] - s2) / np.maximum(ss[live], 1e-300)
        rows = live[better]
        theta[rows], jac[rows], res[rows], ss[rows] = trial[better], j2[better], r2[better], s2[better]
        lam[live] = np.clip(np.where(better, lam[live] * 0.3, lam[live] * 5.0), 1e-12, 1e12)
        stop = (better & (gain < tol)) | (~better & (lam[live] >= 1e9))
        live = live[~stop]
    if ended is not None:
        ended[:] = True
        ended[live] = False
    return theta, ss


def template_model(c: Compiled) -> Model:
    def run(theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = np.zeros_like(x)
        jac = np.zeros((*x.shape, theta.shape[1]))
        for (ia, ratio), ic, (iw, idelta), ie in zip(c.amp, c.centre, c.width, c.mix):
            a, eta = ratio * theta[:, ia, None], theta[:, ie, None]
            stretch = 1.0 + theta[:, idelta, None] if idelta >= 0 else 1.0
            w = np.maximum(theta[:, iw, None] * stretch, 1e-6)
            t = x - theta[:, ic, None]
            g, s = w / 2.0, w / FWHM_PER_SIGMA
            lor, gau = 1.0 / (1.0 + (t / g) ** 2), np.exp(-t * t / (2.0 * s * s))
            shape = eta * lor + (1.0 - eta) * gau
            f += a * shape
            jac[:, :, ia] += ratio * shape
            jac[:, :, ic] += a * (eta * 2.0 * t / g**2 * lor**2 + (1.0 - eta) * t / s**2 * gau)
            dw = a * (eta * t * t / g**3 * lor**2 + (1.0 - eta) * t * t / s**3 * gau / FWHM_PER_SIGMA)
            jac[:, :, iw] += dw * stretch
            if idelta >= 0:
                jac[:, :, idelta] += dw * theta[:, iw, None]
            jac[:, :, ie] += a * (lor - gau)
        return f, jac

    return run


def gaussian_model(n: int) -> Model:
    """(amplitude, centre, sigma) per line and one common shift at the end."""

    def run(theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, jac = np.zeros_like(x), np.zeros((*x.shape, 3 * n + 1))
        for k in range(n):
            a, c, s = (theta[:, 3 * k + m, None] for m in range(3))
            z = (x - c - theta[:, -1, None]) / (s + 1e-12)
            g = np.exp(-0.5 * z * z)
            f += a * g
            jac[:, :, 3 * k] = g
            jac[:, :, 3 * k + 1] = a * g * z / s
            jac[:, :, 3 * k + 2] = a * g * z * z / s
            jac[:, :, -1] += a * g * z / s
        return f, jac

    return run


def edge_model() -> Model:
    """Fermi-Dirac edge: position, width, height, offset."""

    def run(theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ef, kt, scale, base = (theta[:, m, None] for m in range(4))
        z = np.clip((x - ef) / kt, -500.0, 500.0)
        h = 1.0 / (np.exp(z) + 1.0)
        d = h * (1.0 - h)
        return scale * h + base, np.stack([scale * d / kt, scale * d * z / kt, h, np.ones_like(x)], axis=2)

    return run


def free_model(n: int) -> Model:
    """n pseudo-Voigt lines (amplitude, centre, fwhm, mix) on a straight line (offset, slope around the middle)."""
    lines = [Line(str(k), Bound(0, 0, 1), Bound(0, 0, 1), Bound(0, 0, 1), Bound(0, 0, 1)) for k in range(n)]
    c = Compiled(RegionTemplate("", "", 0, 0, lines), np.empty(0), np.empty(0), np.empty(0),
                 [(4 * k, 1.0) for k in range(n)], [4 * k + 1 for k in range(n)], [(4 * k + 2, -1) for k in range(n)],
                 [4 * k + 3 for k in range(n)])
    peaks = template_model(c)

    def run(theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, jac = peaks(theta, x)
        u = x - x.mean(1, keepdims=True)
        jac[:, :, -2], jac[:, :, -1] = 1.0, u
        return f + theta[:, -2, None] + theta[:, -1, None] * u, jac

    return run


def _padded(xs: Sequence, ys: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (x, used), (y, _) = _matrix(xs), _matrix(ys)
    last = np.where(used.any(1), x[np.arange(len(x)), np.maximum(used.sum(1) - 1, 0)] if x.shape[1] else 0.0, 0.0)
    return np.where(used, x, last[:, None]), y, used.astype(float)


def _matrix(lists: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Lists as the rows of a matrix, filled up with zeros, and which places are used."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    used = np.arange(sizes.max(initial=0))[None, :] < sizes[:, None]
    out = np.zeros(used.shape)
    if used.any():
        out[used] = np.concatenate([np.asarray(v, dtype=float) for v in lists])
    return out, used


def _row_bounds(c: Compiled, top: np.ndarray, peak_ev: Sequence, peak_h: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Amplitude bounds follow the data when it is much stronger than the template; starts follow nearby peaks."""
    rows = len(top)
    start, lo, hi = (np.repeat(v[None, :], rows, 0) for v in (c.start, c.lo, c.hi))
    (places, known), (heights, _) = _matrix(peak_ev), _matrix(peak_h)
    for n in c.own_amp:
        line, k = c.region.lines[n], c.amp[n][0]
        scale = np.maximum(top, 1.0) / max(line.amplitude.hi, 1.0)
        strong = scale > 1.5
        hi[strong, k] = line.amplitude.hi * scale[strong] * 3.0
        guess = np.full(rows, line.amplitude.init) if line.amplitude.init is not None else top / max(1, len(c.amp))
        guess = np.where(strong, guess * scale, guess)
        near = line.binding_energy.init
        near = (line.binding_energy.lo + line.binding_energy.hi) / 2 if near is None else near
        if places.shape[1]:
            gap = np.where(known, np.abs(places - near), np.inf)
            nearest = gap.argmin(1)
            found = gap[np.arange(rows), nearest] < 3.0
            guess = np.where(found, 0.8 * heights[np.arange(rows), nearest], guess)
        start[:, k] = np.clip(guess, lo[:, k], hi[:, k])
    return start, lo, hi


FIT_SCHEMA = ("component string, ord int, amplitude double, center_ev double, fwhm_ev double, eta_mix double, "
              "r_squared double, n_points int, status string")


def fit_templates(packed: DataFrame, templates: Sequence[RegionTemplate], keys: Sequence[str], region: str = "region",
                  min_points: int = 5, seeds: bool = True) -> DataFrame:
    """Fit every spectrum with its region's template: one row per line with parameters and R2.

    packed: keys, region, energy, intensity (ascending). Spectra without a template or with too few points inside the
    template's range give one row with status `no_template` / `too_few_points` and NULL parameters. Fits that used up
    their steps have status `not_converged` and the parameters reached.
    """
    compiled = {t.region: compile_template(t) for t in templates}
    spans = {t.region: (t.lo, t.hi) for t in templates}
    rule = F
    for name, (a, b) in spans.items():
        rule = rule.when(F.col(region) == name, F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")))
    d = packed.withColumn("_r", rule.otherwise(None) if spans else F.lit(None))
    cut = F.filter(F.arrays_zip("energy", "intensity"), lambda p: p["energy"].between(F.col("_r.lo"), F.col("_r.hi")))
    d = materialise(d, _roi=F.when(F.col("_r").isNotNull(), cut))
    empty = F.array().cast("array<double>")
    d = materialise(d, _x=F.coalesce(F.col("_roi")["energy"], empty), _raw=F.coalesce(F.col("_roi")["intensity"], empty))
    d = d.withColumn("_bg", shirley_packed(F.col("_x"), F.col("_raw")))
    d = d.withColumn("_y", F.zip_with("_raw", "_bg", lambda y, b: F.greatest(y - b, F.lit(0.0))))
    if seeds:
        d = materialise(materialise(d, _y=F.col("_y")), _s=savgol(F.col("_y"), 11, 2, 11))
        d = find_peaks(d, "_s", "_p")
        top = F.coalesce(F.array_max("_y"), F.lit(0.0))
        d = d.withColumn("_p", F.filter("_p", lambda p: p["prominence"] >= 0.1 * top))
        d = d.withColumn("_pe", F.transform("_p", lambda p: F.get("_x", p["i"]))) \
            .withColumn("_ph", F.transform("_p", lambda p: F.get("_y", p["i"])))
    else:
        d = d.withColumn("_pe", empty).withColumn("_ph", empty)
    # the fit costs far more than moving its input, so it gets the session's full parallelism
    d = spread(d.select(*keys, region, "_x", "_y", "_pe", "_ph"))
    names = [*keys, region]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby(region, sort=False, dropna=False):
                c = compiled.get(name)
                enough = part["_x"].map(len).to_numpy() >= min_points
                status = "no_template" if c is None else "too_few_points"
                skipped = part if c is None else part[~enough]
                if len(skipped):
                    out = skipped[names].copy()
                    out["component"], out["ord"], out["status"] = None, 0, status
                    for col in ("amplitude", "center_ev", "fwhm_ev", "eta_mix", "r_squared"):
                        out[col] = np.nan
                    out["n_points"] = skipped["_x"].map(len)
                    yield out[[*names, *(f.split()[0] for f in FIT_SCHEMA.split(", "))]]
                if c is None or not enough.any():
                    continue
                part = part[enough]
                x, y, w = _padded(part["_x"].to_list(), part["_y"].to_list())
                top = np.maximum(y.max(1), 1e-6)
                start, lo, hi = _row_bounds(c, top, part["_pe"].to_list(), part["_ph"].to_list())
                ended, ended2 = np.zeros(len(part), dtype=bool), np.zeros(len(part), dtype=bool)
                theta, ss = bounded_lm(template_model(c), start, lo, hi, x, y, w, ended=ended)
                plain = np.clip(np.repeat(c.start[None, :], len(part), 0), lo, hi)
                other, s2 = bounded_lm(template_model(c), plain, lo, hi, x, y, w, ended=ended2)
                swap = s2 < ss
                theta[swap], ss[swap], ended[swap] = other[swap], s2[swap], ended2[swap]
                n = w.sum(1)
                mean = (y * w).sum(1) / n
                tot = (((y - mean[:, None]) ** 2) * w).sum(1)
                r2 = np.where(tot > 0, 1.0 - ss / np.where(tot > 0, tot, 1.0), 0.0)
                for k, line in enumerate(c.region.lines):
                    (ia, ratio), (iw, idelta) = c.amp[k], c.width[k]
                    out = part[names].copy()
                    out["component"], out["ord"] = line.name, k
                    out["amplitude"] = np.maximum(theta[:, ia] * ratio, 0.0)
                    out["center_ev"] = theta[:, c.centre[k]]
                    out["fwhm_ev"] = np.maximum(theta[:, iw] * (1.0 + theta[:, idelta] if idelta >= 0 else 1.0), 0.1)
                    out["eta_mix"] = np.clip(theta[:, c.mix[k]], 0.0, 1.0)
                    out["r_squared"], out["n_points"], out["status"] = r2, n.astype(int), np.where(ended, "ok", "not_converged")
                    yield out

    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    return d.mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", " + FIT_SCHEMA)


# ---- evaluation from parameters ---------------------------------------------

def fit_curves(points: DataFrame, params: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Point-wise line values; params has one row per (keys, component), so a spectrum meets only its own lines."""
    d = points.join(params.select(*keys, "component", "amplitude", "center_ev", "fwhm_ev", "eta_mix"), list(keys))
    return d.withColumn("curve", pseudo_voigt(F.col("energy"), F.col("amplitude"), F.col("center_ev"), F.col("fwhm_ev"), F.col("eta_mix")))


def evaluate_fit(points: DataFrame, params: DataFrame, keys: Sequence[str], y: str = "corrected", share: float = 2.0) -> DataFrame:
    """Area and share per line, R2 of the sum; lines below `share` percent are dropped, shares keep their base."""
    curves = fit_curves(points, params, keys)
    w = along([*keys, "component"])
    seg = (F.col("energy") - F.lag("energy").over(w)) * (F.col("curve") + F.lag("curve").over(w)) / 2.0
    areas = curves.withColumn("_seg", seg).groupBy(*keys, "component").agg(
        F.abs(F.coalesce(F.sum("_seg"), F.lit(0.0))).alias("area_counts"))
    fit = curves.groupBy(*keys, "i").agg(F.first(y).alias("_y"), F.sum("curve").alias("_f"))
    e = F.col("_y") - F.col("_f")
    quality = fit.groupBy(*keys).agg(F.sum(e * e).alias("_sse"), (F.var_pop("_y") * F.count("*")).alias("_sst"))
    quality = quality.select(*keys, F.when(F.col("_sst") > 0, 1.0 - F.col("_sse") / F.col("_sst")).otherwise(0.0).alias("r_squared"))
    total = F.sum("area_counts").over(Window.partitionBy(*keys))
    shares = areas.withColumn("total_area", total).withColumn(
        "area_percent", F.when(F.col("total_area") > 0, F.col("area_counts") / F.col("total_area") * 100.0).otherwise(0.0))
    return shares.filter(F.col("area_percent") >= share).join(quality, list(keys))


def fit_residuals(points: DataFrame, params: DataFrame, keys: Sequence[str], y: str = "corrected") -> DataFrame:
    c = fit_curves(points, params, keys).groupBy(*keys, "i").agg(F.first("energy").alias("energy"), F.first(y).alias(y), F.sum("curve").alias("fit"))
    return c.withColumn("residual", F.col(y) - F.col("fit"))


def compatibility(points: DataFrame, spans: dict[str, tuple[float, float]], keys: Sequence[str], fits: DataFrame | None = None,
                  snr_threshold: float = 3.0) -> DataFrame:
    """Can a region template be applied: points, noise of the first tenth, coverage, detectability, quick-fit R2."""
    from lumenfold.operators.points import whole
    g = whole(keys)
    lo = F.create_map(*[F.lit(v) for r, (a, _) in spans.items() for v in (r, a)])
    hi = F.create_map(*[F.lit(v) for r, (_, b) in spans.items() for v in (r, b)])
    d = points.withColumn("_n", F.count("*").over(g)).withColumn("_lo", F.try_element_at(lo, F.col("region"))) \
        .withColumn("_hi", F.try_element_at(hi, F.col("region")))
    head = F.col("i") < F.greatest(F.lit(5), F.floor(F.col("_n") / 10))
    inside = F.col("energy").between(F.col("_lo"), F.col("_hi"))
    s = d.groupBy(*keys, "region").agg(
        F.count("*").alias("n"), F.stddev_pop(F.when(head, F.col("intensity"))).alias("noise"),
        (F.max("intensity") - F.min("intensity")).alias("_span"), F.min("energy").alias("_e0"), F.max("energy").alias("_e1"),
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.count_if(inside).alias("_m"),
        (F.max(F.when(inside, F.col("intensity"))) - F.min(F.when(inside, F.col("intensity")))).alias("_local"))
    snr = F.when(F.col("noise") > 0, F.col("_span") / F.col("noise")).otherwise(0.0)
    covered = F.coalesce((F.col("_lo") >= F.col("_e0")) & (F.col("_hi") <= F.col("_e1")), F.lit(False))
    visible = F.coalesce((F.col("_m") >= 10) & (F.col("_local") > 1.5 * F.col("noise")), F.lit(False))
    out = s.select(*keys, "region", "n", snr.alias("snr"), covered.alias("energy_covered"), visible.alias("peaks_detectable"))
    if fits is not None:
        quick = fits.groupBy(*keys).agg(F.max("r_squared").alias("r_squared"))
        out = out.join(quick, list(keys), "left")
    else:
        out = out.withColumn("r_squared", F.lit(None).cast("double"))
    warnings = F.array_compact(F.array(
        F.when(F.col("snr") < snr_threshold, "low snr"), F.when(~F.col("energy_covered"), "region outside data"),
        F.when(~F.col("peaks_detectable"), "no clear peak"), F.when(F.col("r_squared") < 0.5, "template may not match")))
    return out.withColumn("warnings", warnings).withColumn("passed", (F.col("n") >= 20) & F.col("energy_covered"))


def choose_template(region: Column, names: Sequence[str], explicit: dict[str, str] | None = None) -> Column:
    """Explicit map first, then equal without case, then the template name that contains the region."""
    rule = F
    for r, t in (explicit or {}).items():
        rule = rule.when(region == r, t)
    for t in names:
        rule = rule.when(F.upper(region) == t.upper(), t)
    for t in names:
        rule = rule.when(F.contains(F.lit(t.upper()), F.upper(region)), t)
    return rule.otherwise(None)


# ---- other bounded fits -----------------------------------------------------

def fit_gaussians(energy: np.ndarray, intensity: np.ndarray, initial: Sequence[tuple[float, float]], reach: float = 0.5) -> np.ndarray:
    """Average-spectrum fit on the driver (one curve): amplitude, centre, sigma per line and a common shift."""
    start, lo, hi = [], [], []
    for c, s in initial:
        start += [max(1e-3, float(intensity[np.abs(energy - c).argmin()])), c, max(s, 1e-3)]
        lo += [0.0, c - 0.5, 0.05]
        hi += [np.inf, c + 0.5, 3.0]
    start, lo, hi = [*start, 0.0], [*lo, -reach], [*hi, reach]
    theta, _ = bounded_lm(gaussian_model(len(initial)), np.array([start]), np.array([lo]), np.array([hi]),
                          energy[None, :], intensity[None, :], np.ones((1, len(energy))))
    return theta[0]


def _fit_column(energy: Column, intensity: Column, ddl: str, fn: Callable) -> Column:
    @F.pandas_udf(ddl)
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        return fn(xs.to_list(), ys.to_list())

    return run(energy, intensity)


def fit_edge(energy: Column, intensity: Column, window: float = 1.0, width: float = 0.1, min_points: int = 20) -> Column:
    """STRUCT(edge_ev, width_ev, height, offset, top) of the points within +-window of 0; NULL edge when too few."""

    def fn(xs: list, ys: list) -> pd.DataFrame:
        out = pd.DataFrame(np.full((len(xs), 5), np.nan), columns=["edge_ev", "width_ev", "height", "offset", "top"])
        cut = []
        for x, y in zip(xs, ys):
            x, y = np.asarray(x, float), np.asarray(y, float)
            m = np.abs(x) <= window
            order = np.argsort(x[m], kind="stable")
            cut.append((x[m][order], y[m][order]))
        use = [r for r, (x, _) in enumerate(cut) if len(x) >= min_points]
        if use:
            x, y, w = _padded([cut[r][0] for r in use], [cut[r][1] for r in use])
            top = np.where(w > 0, y, -np.inf).max(1)
            low = np.where(w > 0, y, np.inf).min(1)
            start = np.stack([np.zeros(len(use)), np.full(len(use), width), top - low, low], 1)
            lo = np.tile([-window, 0.01, -np.inf, -np.inf], (len(use), 1))
            hi = np.tile([window, 5.0, np.inf, np.inf], (len(use), 1))
            theta, _ = bounded_lm(edge_model(), start, lo, hi, x, y, w)
            out.iloc[use, :4] = theta
            out.iloc[use, 4] = top
        return out

    return _fit_column(energy, intensity, "edge_ev double, width_ev double, height double, offset double, top double", fn)


def fit_free(energy: Column, intensity: Column, n_peaks: int = 2, min_points: int = 20) -> Column:
    """STRUCT(centers, fwhms, amplitudes, r_squared): n lines with wide bounds on a straight line, no template."""

    def fn(xs: list, ys: list) -> pd.DataFrame:
        out = pd.DataFrame({"centers": [None] * len(xs), "fwhms": [None] * len(xs), "amplitudes": [None] * len(xs),
                            "r_squared": np.nan})
        use = [r for r, x in enumerate(xs) if len(x) >= min_points]
        if not use:
            return out
        x, y, w = _padded([xs[r] for r in use], [ys[r] for r in use])
        rows = np.arange(len(use))
        start = np.zeros((len(use), 4 * n_peaks + 2))
        lo, hi = np.zeros_like(start), np.zeros_like(start)
        span = x.max(1) - x.min(1)
        base, top = np.where(w > 0, y, np.inf).min(1), np.where(w > 0, y, -np.inf).max(1)
        rest = np.where(w > 0, y - base[:, None], -np.inf)
        for k in range(n_peaks):
            at = rest.argmax(1)
            c = x[rows, at]
            start[:, 4 * k:4 * k + 4] = np.stack([np.maximum(rest[rows, at], 1e-6), c, np.minimum(1.5, span), np.full(len(use), 0.3)], 1)
            lo[:, 4 * k:4 * k + 4] = np.stack([np.zeros(len(use)), x.min(1), np.full(len(use), 0.1), np.zeros(len(use))], 1)
            hi[:, 4 * k:4 * k + 4] = np.stack([10.0 * (top - base) + 1.0, x.max(1), span + 0.2, np.ones(len(use))], 1)
            rest = np.where(np.abs(x - c[:, None]) < 1.0, -np.inf, rest)
            rest = np.where(np.isfinite(rest).any(1, keepdims=True), rest, 0.0)
        start[:, -2], lo[:, -2:], hi[:, -2:] = base, -np.inf, np.inf
        theta, ss = bounded_lm(free_model(n_peaks), start, lo, hi, x, y, w)
        mean = (y * w).sum(1) / w.sum(1)
        tot = (((y - mean[:, None]) ** 2) * w).sum(1)
        order = np.argsort(theta[:, 1:4 * n_peaks:4], axis=1)
        for name, m in (("centers", 1), ("fwhms", 2), ("amplitudes", 0)):
            values = np.take_along_axis(theta[:, m:4 * n_peaks:4], order, 1)
            out.loc[use, name] = pd.Series(list(values), index=use)
        out.loc[use, "r_squared"] = np.where(tot > 0, 1.0 - ss / np.where(tot > 0, tot, 1.0), 0.0)
        return out

    return _fit_column(energy, intensity, "centers array<double>, fwhms array<double>, amplitudes array<double>, r_squared double", fn)


def compare_fits(template_fit: DataFrame, free: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Template and free fit next to each other, lines paired by their order along the energy axis."""
    w = Window.partitionBy(*keys).orderBy("center_ev", "ord")
    a = template_fit.filter(F.col("status").isin("ok", "not_converged")).withColumn("peak", F.row_number().over(w)).select(
        *keys, "peak", F.col("center_ev").alias("template_center"), F.col("fwhm_ev").alias("template_fwhm"), F.col("r_squared").alias("template_r2"))
    b = free.select(*keys, F.posexplode(F.arrays_zip(F.col("free.centers").alias("c"), F.col("free.fwhms").alias("w"))).alias("p", "z"),
                    F.col("free.r_squared").alias("free_r2")).select(
        *keys, (F.col("p") + 1).alias("peak"), F.col("z.c").alias("free_center"), F.col("z.w").alias("free_fwhm"), "free_r2")
    return a.join(b, [*keys, "peak"], "full")


def label_components(fits: DataFrame, areas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest-area line as label, total area and R2 per fitted component; failures keep a row with area 0."""
    best = areas.groupBy(*keys).agg(F.max_by("component", F.struct("area_counts")).alias("label"), F.sum("area_counts").alias("total_area"),
                                    F.max("r_squared").alias("r_squared"))
    every = fits.select(*keys).distinct()
    failed = F.concat(F.lit("Component_"), *[F.col(k).cast("string") for k in keys], F.lit("_FitFailed"))
    return every.join(best, list(keys), "left").select(
        *keys, F.coalesce("label", failed).alias("label"), F.coalesce("total_area", F.lit(0.0)).alias("total_area"),
        F.coalesce("r_squared", F.lit(0.0)).alias("r_squared"))
