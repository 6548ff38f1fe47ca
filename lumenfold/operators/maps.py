"""Hyperspectral maps: one row per pixel with a packed spectrum; masks, statistics, alignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scalars import array_sum, rotate, spectrum_entropy
from lumenfold.session import join_stats, settled, spread

#: Rows of a block of pixels; pairs of blocks are compared at once.
BLOCK = 1024


def channel_moments(spectra: DataFrame, keys: Sequence[str] = (), column: str = "intensity") -> DataFrame:
    """n, mean and population deviation arrays over pixels: one vector aggregate, combined map-side, no explode."""
    s = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.col(column)))
    g = spectra.groupBy(*keys).agg(s.alias("_s"))
    n = F.col("_s.count")
    var = vector_to_array("_s.variance")
    return g.select(*keys, n.alias("n"), vector_to_array("_s.mean").alias("mean"),
                    F.transform(var, lambda v: F.sqrt(v * (n - 1) / n)).alias("std"))


def variability(spectra: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and maximum over channels of the deviation across pixels, and their ratio to the mean level."""
    m = channel_moments(spectra, keys)
    p = F.size("std")
    mean_sigma = array_sum(F.col("std")) / p
    return m.select(*keys, "n", mean_sigma.alias("mean_sigma"), F.array_max("std").alias("max_sigma"),
                    (mean_sigma / (array_sum(F.col("mean")) / p + 1e-12)).alias("cv"))


def sampled_pixels(spectra: DataFrame, index: str, n_pixels: int, samples: int = 20) -> DataFrame:
    """Pixels at evenly spaced running numbers (the sampling itself is the operator)."""
    wanted = sorted({int(v) for v in np.linspace(0, n_pixels - 1, min(samples, n_pixels))})
    return spectra.filter(F.col(index).isin(wanted))


def entropy_statistics(spectra: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    e = spectra.select(*keys, spectrum_entropy(F.col("intensity")).alias("_e"))
    return e.groupBy(*keys).agg(F.avg("_e").alias("mean"), F.stddev_pop("_e").alias("std"),
                                (F.max("_e") - F.min("_e")).alias("range"))


def worth_decomposing(mean_sigma: Column, max_sigma: Column, entropy_sigma: Column) -> Column:
    """Rule that starts the decomposition by itself."""
    return (mean_sigma > 15) | (max_sigma > 30) | (entropy_sigma > 0.5)


# ---- masks ------------------------------------------------------------------

def low_count_mask(column: Column, threshold: float) -> Column:
    return array_sum(column) >= threshold


def intensity_mask(column: Column, threshold: float, how: str = "total") -> Column:
    total = array_sum(column)
    return (total if how == "total" else total / F.size(column)) > threshold


def zero_masked(mask: Column, column: Column) -> Column:
    return F.when(mask, column).otherwise(F.transform(column, lambda v: F.lit(0.0)))


def score_mask(scored: DataFrame, score: str, threshold: float = 0.5, out: str = "mask",
               maps: Sequence[str] = ()) -> DataFrame:
    """Score above a threshold after min-max scaling within its map; a constant score keeps everything."""
    edge = scored.groupBy(*maps).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    d = join_stats(scored, edge, list(maps)) if maps else scored.crossJoin(F.broadcast(edge))  # one row without a key
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    return d.withColumn(out, scaled > threshold).drop("_lo", "_hi")


def cluster_mask(label: Column, wanted: Sequence[int], n_clusters: int) -> Column:
    """Labels in the list; numbers out of range are ignored and an empty list keeps everything."""
    valid = [c for c in wanted if 0 <= c < n_clusters]
    return label.isin(valid) if valid else F.lit(True)


def combine_masks(a: DataFrame, b: DataFrame, pixel: Sequence[str], how: str = "and") -> DataFrame:
    j = a.select(*pixel, F.col("mask").alias("_a")).join(b.select(*pixel, F.col("mask").alias("_b")), list(pixel), "full")
    missing = F.raise_error("masks cover different pixels").cast("boolean")
    both = F.when(F.col("_a").isNull() | F.col("_b").isNull(), missing).otherwise(
        (F.col("_a") & F.col("_b")) if how == "and" else (F.col("_a") | F.col("_b")))
    return j.select(*pixel, both.alias("mask"))


def resolve_parameter(element: Column, has_element: Column, general: Column, has_general: Column, top: Column) -> Column:
    """Element over global over top level; a present key wins even when its value is NULL."""
    return F.when(has_element, element).when(has_general, general).otherwise(top)


def crop(spectra: DataFrame, axis: Sequence[float], lo: float, hi: float, column: str = "intensity") -> tuple[DataFrame, list[float]]:
    """Keep the channels inside [lo, hi]; nothing changes when none is inside."""
    inside = [k for k, e in enumerate(axis) if min(lo, hi) <= e <= max(lo, hi)]
    if not inside:
        return spectra, list(axis)
    cut = F.slice(column, inside[0] + 1, inside[-1] - inside[0] + 1)
    return spectra.withColumn(column, cut), list(axis[inside[0]:inside[-1] + 1])


def channel_mask(spectra: DataFrame, threshold: float, maps: Sequence[str] = (), column: str = "intensity") -> DataFrame:
    """Zero the channels whose map mean is not above the threshold; skipped when no channel is above it."""
    keys = list(maps) or ["_all"]
    df = spectra if maps else spectra.withColumn("_all", F.lit(0))
    keep = channel_moments(df, keys, column).select(*keys, F.transform("mean", lambda v: v > threshold).alias("_k"))
    d = join_stats(df, keep, keys)
    masked = F.zip_with(column, "_k", lambda v, k: F.when(k, v).otherwise(0.0))
    out = d.withColumn(column, F.when(F.exists("_k", lambda k: k), masked).otherwise(F.col(column))).drop("_k")
    return out if maps else out.drop("_all")


# ---- alignment --------------------------------------------------------------

def align_to(spectra: DataFrame, axis: Sequence[float], reference: float, window: float = 1.0, column: str = "intensity") -> DataFrame:
    """Roll each spectrum so that its local maximum near the reference energy lands on the closest channel."""
    gaps = [abs(e - reference) for e in axis]
    at = gaps.index(min(gaps))
    near = [k for k, g in enumerate(gaps) if g <= window] or [at]
    part = F.slice(column, near[0] + 1, len(near))
    top = F.array_position(part, F.array_max(part)).cast("int") - 1 + near[0]
    return spectra.withColumn("shift", F.lit(at) - top).withColumn(column, rotate(F.col(column), F.col("shift")))


def correlation_lags(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Sums of x[i] r[i - lag] of all rows for the lags from -(p - 1) to p - 1, by FFT."""
    p = len(r)
    size = 1 << (2 * p - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(r, size)), size)
    return np.concatenate([full[:, size - (p - 1):], full[:, :p]], axis=1)


def correlation_shift(column: Column, reference: Sequence[float], step_ev: float, max_bins: int = 10) -> Column:
    """Shift in eV by the best cross-correlation lag against a reference spectrum, clipped to max_bins."""
    r = np.asarray(reference, float)
    r = (r - r.mean()) / (r.std() + 1e-12)
    lags = np.arange(-(len(r) - 1), len(r))

    @F.pandas_udf("double")
    def run(xs: pd.Series) -> pd.Series:
        best = np.zeros(len(xs), dtype=np.int64)
        size = max(1, (1 << 20) // len(r))
        for at in range(0, len(xs), size):
            x = np.stack(xs.iloc[at:at + size].to_list()).astype(float)
            x = (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-12)
            best[at:at + size] = lags[np.argmax(correlation_lags(x, r), axis=1)]
        return pd.Series(np.clip(best, -max_bins, max_bins) * step_ev)

    return run(column)


# ---- clusters and residuals -------------------------------------------------

def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def cluster_profiles(pixels: DataFrame, label: str, pixel: str, scores: str, spectrum: str = "intensity",
                     maps: Sequence[str] = ()) -> DataFrame:
    """Size, mean spectrum, centroid score and medoid pixel (lowest number on ties) per map and cluster."""
    keys = [*maps, label]
    means = channel_moments(pixels, keys, spectrum).select(*keys, F.col("n").alias("size"), F.col("mean").alias("mean_spectrum"))
    centres = channel_moments(pixels, keys, scores).select(*keys, F.col("mean").alias("centroid"))
    d = join_stats(pixels.select(*keys, pixel, scores), centres, keys)
    medoid = d.groupBy(*keys).agg(F.min_by(pixel, F.struct(squared_distance(F.col(scores), F.col("centroid")), F.col(pixel))).alias("medoid"))
    return means.join(centres, keys).join(medoid, keys)


def cluster_sizes(pixels: DataFrame, label: str, maps: Sequence[str] = ()) -> DataFrame:
    """Pixels of each cluster and their share of the map."""
    g = pixels.groupBy(*maps, label).agg(F.count("*").alias("size"))
    total = g.groupBy(*maps).agg(F.sum("size").alias("_t"))
    d = g.join(total, list(maps)) if maps else g.crossJoin(F.broadcast(total))  # one row without a key
    return d.select(*maps, label, "size", (F.col("size") / F.col("_t") * 100.0).alias("percent"))


def residual_metrics(pixels: DataFrame, spectrum: str = "intensity", model: str = "model") -> DataFrame:
    """Per-pixel R2 (1 for flat spectra), lack of fit, mse and the sums that give the totals."""
    x, n = F.col(spectrum), F.size(spectrum)
    res = squared_distance(x, F.col(model))
    mean = array_sum(x) / n
    tot = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) - n * mean * mean
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)) + 1e-12
    d = pixels.withColumn("ss_res", res).withColumn("ss_tot", F.greatest(tot, F.lit(0.0)))
    return (d.withColumn("r2", F.when(F.col("ss_tot") > 1e-12, 1.0 - F.col("ss_res") / F.col("ss_tot")).otherwise(1.0))
            .withColumn("lof", F.sqrt("ss_res") / norm).withColumn("mse", F.col("ss_res") / n))


def residual_totals(metrics: DataFrame, spectrum: str = "intensity") -> DataFrame:
    """Overall R2 by pixel sums, R2 against the global mean, mean lack of fit and RMS."""
    n = F.sum(F.size(spectrum))
    sq = F.sum(F.aggregate(F.col(spectrum), F.lit(0.0), lambda s, v: s + v * v))
    total = F.sum(array_sum(F.col(spectrum)))
    return metrics.agg(
        (1.0 - F.sum("ss_res") / (F.sum("ss_tot") + 1e-12)).alias("total_r2"), F.avg("lof").alias("mean_lof"),
        (1.0 - F.sum("ss_res") / (sq - total * total / n)).alias("global_r2"), F.sqrt(F.sum("ss_res") / n).alias("rms"))


def silhouette(pixels: DataFrame, label: str, spectrum: str = "intensity", key: str = "vec_id", maps: Sequence[str] = ()) -> DataFrame:
    """Silhouette of every pixel in its map by mean squared Euclidean distances: a pass for the clusters' sums, one for the pixels.

    The mean squared distance to a cluster follows from its size, its mean and its mean squared norm, so the work grows
    with the pixels and not with their pairs. A pixel alone in its cluster has 0. A map's clusters are one row.
    """
    keys = [*maps, label]
    clusters = channel_moments(pixels, keys, spectrum).select(*keys, F.col("mean").alias("_m"))
    norms = pixels.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(F.aggregate(spectrum, F.lit(0.0), lambda s, v: s + v * v)).alias("_q"))
    table = clusters.join(norms, keys).withColumnRenamed(label, "_l")
    table = table.groupBy(*maps).agg(F.collect_list(F.struct("_l", "_n", "_m", "_q")).alias("_c"))
    own = F.col(label)
    square = F.aggregate(spectrum, F.lit(0.0), lambda s, v: s + v * v)

    def distance(c: Column) -> Column:
        dot = F.aggregate(F.zip_with(spectrum, c["_m"], lambda v, m: v * m), F.lit(0.0), lambda s, v: s + v)
        return F.greatest(square + c["_q"] - 2.0 * dot, F.lit(0.0))

    d = join_stats(pixels, table, list(maps)) if maps else pixels.crossJoin(F.broadcast(table))  # one row without a key
    mine = F.get(F.filter("_c", lambda c: c["_l"] == own), F.lit(0))
    d = d.withColumn("_size", mine["_n"]).withColumn("_a", distance(mine) * mine["_n"] / F.nullif(mine["_n"] - 1, F.lit(0)))
    d = d.withColumn("_b", F.array_min(F.transform(F.filter("_c", lambda c: c["_l"] != own), distance)))
    top = F.greatest("_a", "_b")
    value = F.when((F.col("_size") > 1) & (top > 0), (F.col("_b") - F.col("_a")) / F.nullif(top, F.lit(0.0))).otherwise(0.0)
    return d.select(key, *keys, F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def sampled_silhouette(pixels: DataFrame, label: str, spectrum: str = "intensity", key: str = "vec_id", sample: int | None = 5000,
                       seed: int = 0) -> DataFrame:
    """Per-pixel Euclidean silhouette on a seeded sample of at most `sample` pixels; None takes every pixel.

    All pairs are compared, so the work grows with the square of the pixels. They are packed into blocks of at most
    BLOCK rows, and Spark pairs the blocks: a task holds two blocks and 64 MB of the second side, whatever the table's
    size. No pair rows exist: a task adds up a pixel's distances to each cluster.
    """
    rows = pixels.select(key, label, spectrum)
    if sample is not None:
        rows = rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def pack(batches):
        for pdf in batches:
            for begin in range(0, len(pdf), BLOCK):
                part = pdf.iloc[begin:begin + BLOCK]
                m = np.stack(part[spectrum].to_list()).astype(float)
                yield pd.DataFrame({"keys": [part[key].to_list()], "labels": [[None if pd.isna(v) else v for v in part[label]]],
                                    "width": [m.shape[1]], "values": [m.tobytes()]})

    fields = f"keys array<{kinds[key]}>, labels array<{kinds[label]}>, width int, values binary"
    # written once, as both sides of the pairs are read from it
    blocks = settled(spread(rows).mapInPandas(pack, fields).withColumn("block", F.monotonically_increasing_id()), "silhouette")
    n = blocks.count()
    size = 8 * BLOCK * (blocks.agg(F.max("width")).first()[0] or 1)
    left, right = blocks.repartition(max(n, 1)), blocks.repartition(-(-n // max(1, (64 << 20) // size)) or 1)
    pairs = left.crossJoin(right.select(*[F.col(c).alias(f"{c}_2") for c in ("keys", "labels", "width", "values")]))

    def compare(batches):
        block, found, own = None, {}, None

        def sums():
            for name, (total, count) in found.items():
                yield pd.DataFrame({key: own[0], label: own[1], "_other": [name] * len(total), "_s": total, "_n": count})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.block != block:
                    yield from sums()
                    x = np.frombuffer(r.values).reshape(-1, r.width)
                    block, found, own = r.block, {}, (r.keys, r.labels)
                y = np.frombuffer(r.values_2).reshape(-1, r.width_2)
                sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * x @ y.T
                away = np.sqrt(np.maximum(sq, 0.0))
                if not set(r.keys).isdisjoint(r.keys_2):
                    away[np.asarray(r.keys)[:, None] == np.asarray(r.keys_2)[None, :]] = 0.0
                which, names = pd.factorize(np.asarray(r.labels_2, dtype=object), use_na_sentinel=False)
                inside = which[:, None] == np.arange(len(names))[None, :]
                total, count = away @ inside.astype(float), inside.sum(0)
                for k, name in enumerate(None if pd.isna(v) else v for v in names):  # null equals and differs from no label
                    before = found.get(name, (0.0, 0))
                    found[name] = before[0] + total[:, k], before[1] + int(count[k])
        yield from sums()

    parts = pairs.mapInPandas(compare, f"{key} {kinds[key]}, {label} {kinds[label]}, _other {kinds[label]}, _s double, _n long")
    means = parts.groupBy(key, label, "_other").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    mine = F.col(label) == F.col("_other")
    ab = means.groupBy(key, label).agg(
        F.max(F.when(mine & (F.col("_n") > 1), F.col("_s") / (F.col("_n") - 1))).alias("_a"),
        F.min(F.when(~mine, F.col("_s") / F.col("_n"))).alias("_b"))
    top = F.greatest("_a", "_b")
    value = F.when(F.col("_a").isNull() | (top == 0), 0.0).otherwise((F.col("_b") - F.col("_a")) / F.nullif(top, F.lit(0.0)))
    return ab.select(key, label, value.alias("silhouette"))


def depth_as_map(spectra: DataFrame, layer: str = "layer") -> DataFrame:
    """Depth layers as the pixels of a one-line map."""
    return spectra.withColumn("y", F.lit(0)).withColumn("x", (F.col(layer) - 1).cast("int"))


def map_summary(pixels: DataFrame, axis: Sequence[float], column: str = "intensity", maps: Sequence[str] = ()) -> DataFrame:
    """Kind, size, energy range and areas of each map."""
    total = array_sum(F.col(column))
    return pixels.groupBy(*maps).agg(
        F.count("*").alias("n_pixels"), F.max(F.size(column)).alias("n_energy"), F.count_if(total > 0).alias("n_nonzero"),
        F.avg(F.when(total > 0, total)).alias("mean_area"), F.stddev_pop(F.when(total > 0, total)).alias("std_area"),
    ).withColumn("energy_min", F.lit(float(min(axis)))).withColumn("energy_max", F.lit(float(max(axis)))) \
        .withColumn("kind", F.when(F.col("n_energy") > 10, "hyperspectral").otherwise("image"))
