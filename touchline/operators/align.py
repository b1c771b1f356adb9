"""Aligning two clips by sound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in a block. Two blocks meet in one FFT of twice the length.
BLOCK = 16384
#: Seconds of sound that a clip needs at least.
LEAST_SECONDS = 0.25


def unit_envelope(samples: DataFrame) -> DataFrame:
    """Mean-free envelopes of unit length: clip, i, amp."""
    stats = samples.groupBy("clip").agg(F.avg("amp").alias("m"), F.sqrt(F.var_pop("amp") * F.count("*")).alias("norm"))
    out = samples.join(stats, "clip")
    return out.select("clip", "i", F.when(F.col("norm") > 0, (F.col("amp") - F.col("m")) / F.col("norm")).otherwise(0.0).alias("amp"))


def coarser(samples: DataFrame, times: int) -> DataFrame:
    """Every ``times`` samples as their mean."""
    return samples.groupBy("clip", F.floor(F.col("i") / times).alias("i")).agg(F.avg("amp").alias("amp"))


def blocks(unit: DataFrame, size: int) -> DataFrame:
    """clip, k, spots, amps: the samples of each block of a clip, ``size`` at most."""
    k = F.floor(F.col("i") / size)
    own = unit.groupBy("clip", k.alias("k")).agg(F.collect_list(F.struct((F.col("i") - k * size).cast("int").alias("s"), F.col("amp").cast("double").alias("v"))).alias("x"))
    return own.select("clip", "k", F.col("x.s").alias("spots"), F.col("x.v").alias("amps"))


def _dense(table: pa.Table, row: int, side: str, size: int) -> np.ndarray:
    out = np.zeros(size)
    out[np.asarray(table.column(f"spots_{side}")[row].values)] = np.asarray(table.column(f"amps_{side}")[row].values)
    return out


def _apart(table: pa.Table, size: int) -> pa.Table:
    """All pairs of blocks that lie the same number of blocks apart: their products are added as spectra and turned back once."""
    spectrum = np.zeros(size + 1, complex)
    for row in range(table.num_rows):
        spectrum += np.conj(np.fft.rfft(_dense(table, row, "a", size), 2 * size)) * np.fft.rfft(_dense(table, row, "b", size), 2 * size)
    sums = np.fft.irfft(spectrum, 2 * size)  # the lag modulo 2 * size
    first = {c: table.column(c)[0].as_py() for c in ("clip_a", "clip_b", "apart")}
    return pa.table({
        "clip_a": [first["clip_a"]] * 2, "clip_b": [first["clip_b"]] * 2, "place": pa.array([first["apart"], first["apart"] - 1], pa.int64()),
        "sums": pa.array([sums[:size], sums[size:]], pa.list_(pa.float64())),
    })


def _best(table: pa.Table, size: int, most: int | None) -> pa.Table:
    """The highest of a block of lags, of which two sets of pairs have a share each; of equal ones the least lag either way."""
    sums = sum(np.asarray(x.values) for x in table.column("sums"))
    lags = table.column("place")[0].as_py() * size + np.arange(size)
    if most is not None:
        sums, lags = sums[np.abs(lags) <= most], lags[np.abs(lags) <= most]
    at = np.lexsort((np.abs(lags), -np.round(sums, 12)))[:1]
    n = len(at)
    return pa.table({"clip_a": table.column("clip_a")[:n], "clip_b": table.column("clip_b")[:n], "lag": pa.array(lags[at], pa.int64()), "r": pa.array(sums[at], pa.float64())})


def correlation_peak(unit: DataFrame, pairs: DataFrame, most: int | None = None, size: int = BLOCK) -> DataFrame:
    """clip_a, clip_b, lag, r: the highest correlation of each pair over all lags (up to ``most`` samples either way).

    Clips are cut into blocks. A task gets the pairs of blocks that lie equally far apart, so a pair of clips takes as many FFTs as it has pairs
    of blocks, and rows are never multiplied by lags.
    """
    own = blocks(unit, size)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    clips = f"clip_a {kinds['clip_a']}, clip_b {kinds['clip_b']}"
    side = lambda s: own.select(F.col("clip").alias(f"clip_{s}"), F.col("k").alias(f"k_{s}"), F.col("spots").alias(f"spots_{s}"), F.col("amps").alias(f"amps_{s}"))
    met = pairs.select("clip_a", "clip_b").distinct().join(side("a").hint("merge"), "clip_a").join(side("b").hint("merge"), "clip_b").withColumn("apart", F.col("k_b") - F.col("k_a"))
    if most is not None:
        met = met.where(F.abs("apart") <= most // size + 1)
    sums = met.groupBy("clip_a", "clip_b", "apart").applyInArrow(lambda t: _apart(t, size), f"{clips}, place long, sums array<double>")
    best = sums.groupBy("clip_a", "clip_b", "place").applyInArrow(lambda t: _best(t, size, most), f"{clips}, lag long, r double")
    return best.groupBy("clip_a", "clip_b").agg(F.max_by("lag", F.struct(F.round("r", 12), -F.abs("lag"))).alias("lag"), F.max("r").alias("r"))


def _window(table: pa.Table, size: int, width: int) -> pa.Table:
    """A block of a against b's samples about it: one sum for each lag of the window."""
    b = np.zeros(size + width)
    for row in range(table.num_rows):
        at = np.asarray(table.column("at_b")[row].values)
        held = (at >= 0) & (at < size + width)
        b[at[held]] = np.asarray(table.column("amps_b")[row].values)[held]
    n = 1 << (2 * size + width).bit_length()
    sums = np.fft.irfft(np.conj(np.fft.rfft(_dense(table, 0, "a", size), n)) * np.fft.rfft(b, n), n)[: width + 1]
    return pa.table({"clip_a": pa.array([table.column("clip_a")[0].as_py()] * len(sums)), "clip_b": pa.array([table.column("clip_b")[0].as_py()] * len(sums)), "step": pa.array(np.arange(len(sums))), "r": pa.array(sums)})


def finer(unit: DataFrame, about: DataFrame, width: int, size: int = BLOCK) -> DataFrame:
    """clip_a, clip_b, lag, r: the highest correlation among the ``width`` + 1 lags from each pair's ``low`` on."""
    own = blocks(unit, size)
    kinds = {f.name: f.dataType.simpleString() for f in about.schema.fields}
    clips = f"clip_a {kinds['clip_a']}, clip_b {kinds['clip_b']}"
    a = about.join(own.select(F.col("clip").alias("clip_a"), F.col("k").alias("k_a"), F.col("spots").alias("spots_a"), F.col("amps").alias("amps_a")).hint("merge"), "clip_a")
    first, last = F.floor((F.col("k_a") * size + F.col("low")) / size), F.floor(((F.col("k_a") + 1) * size + F.col("low") + width) / size)
    a = a.withColumn("k_b", F.explode(F.sequence(first, last)))
    b = own.select(F.col("clip").alias("clip_b"), F.col("k").alias("k_b"), F.col("spots").alias("spots_b"), F.col("amps").alias("amps_b"))
    met = a.join(b.hint("merge"), ["clip_b", "k_b"])
    start = (F.col("k_b") - F.col("k_a")) * size - F.col("low")
    met = met.withColumn("at_b", F.transform("spots_b", lambda s: s + start))
    sums = met.select("clip_a", "clip_b", "k_a", "spots_a", "amps_a", "at_b", "amps_b").groupBy("clip_a", "clip_b", "k_a").applyInArrow(lambda t: _window(t, size, width), f"{clips}, step long, r double")
    total = sums.groupBy("clip_a", "clip_b", "step").agg(F.sum("r").alias("r")).join(about.hint("merge"), ["clip_a", "clip_b"]).withColumn("lag", F.col("low") + F.col("step"))
    return total.groupBy("clip_a", "clip_b").agg(F.max_by("lag", F.struct(F.round("r", 12), -F.abs("lag"))).alias("lag"), F.max("r").alias("r"))


def audio_offset(samples: DataFrame, pairs: DataFrame, most: int | None, rate: float, least_peak: float = 0.05, coarse: float = 100.0, size: int = BLOCK) -> DataFrame:
    """clip_a, clip_b, lag, peak, seconds: the lag (at most ``most`` samples either way; None: any) of highest correlation.

    samples: clip, i, amp; missing and null ones count as the mean. Up to ``coarse`` samples a second all lags are compared as they are; faster sound
    is first compared in means over so much time, and then sample by sample about that peak, two of the coarse steps either way. Clips of less
    than a quarter of a second and pairs whose peak is under ``least_peak`` have no row; silence has no peak.
    """
    samples = samples.where("amp is not null and i is not null")
    long_ = samples.groupBy("clip").agg((F.max("i") - F.min("i") + 1).alias("n")).where(F.col("n") >= LEAST_SECONDS * rate).select("clip")
    samples = samples.join(long_.hint("merge"), "clip", "left_semi")
    times = max(1, int(rate // coarse))
    if times == 1:
        best = correlation_peak(unit_envelope(samples), pairs, most, size)
    else:
        rough = correlation_peak(unit_envelope(coarser(samples, times)), pairs, None if most is None else most // times + 1, size)
        about = rough.select("clip_a", "clip_b", ((F.col("lag") - 2) * times).alias("low"))
        best = finer(unit_envelope(samples), about, 4 * times, size)
        best = best if most is None else best.where(F.abs("lag") <= most)
    return best.where(F.col("r") >= least_peak).select("clip_a", "clip_b", F.col("lag").cast("int").alias("lag"), F.col("r").alias("peak"), (F.col("lag") / F.lit(rate)).alias("seconds"))
