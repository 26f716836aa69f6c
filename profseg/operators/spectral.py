"""Spectra of segments and profiles. Interpolation to an even grid and the transform run in numpy, a group at a time;
everything about frequencies after that is Spark aggregation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import spread
from .intervals import assign

#: Grid step, band and band edges in cycles a depth unit, samples at least.
STEP, LOW, HIGH, SPLIT, LEAST = 0.02, 0.25, 8.0, 2.0, 8
BANDS = ((0.25, 1.0), (1.0, 2.0), (2.0, 4.0), (4.0, 8.0))


def even(depth: np.ndarray, values: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Values on an even grid: missing dropped, duplicates averaged, linear between; None if there are too few."""
    good = np.isfinite(depth) & np.isfinite(values)
    if good.sum() < LEAST:
        return None
    places, where = np.unique(depth[good], return_inverse=True)
    means = np.bincount(where, values[good]) / np.bincount(where)
    if len(places) < 2:
        return None
    grid = places[0] + step * np.arange(math.ceil((places[-1] + step - places[0]) / step))
    return (grid, np.interp(grid, places, means)) if len(grid) >= LEAST else None


def detrended(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Residuals of the least-squares line."""
    x = x - x.mean()
    spread = float((x * x).sum())
    return y - y.mean() - (x * (x @ (y - y.mean())) / spread if spread > 0 else 0.0)


def spectrum(depth: np.ndarray, values: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Frequencies and amplitudes of a detrended, symmetrically Hann-windowed series."""
    if (found := even(depth, values, step)) is None:
        return None
    y = detrended(*found)
    n = len(y)
    return np.fft.rfftfreq(n, step), 2.0 / n * np.abs(np.fft.rfft((y - y.mean()) * np.hanning(n)))


#: Segments of a target that one call takes.
TOGETHER = 64


def spectra_of(series: list[np.ndarray], step: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Series on even grids, those of one length transformed together: (places in the list, frequencies, amplitudes, a row a series)."""
    lengths = np.array([len(y) for y in series], int)
    out = []
    for n in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == n)
        y = np.stack([series[i] for i in places])
        y = y - y.mean(axis=1, keepdims=True)
        x = step * (np.arange(n) - (n - 1) / 2)
        y = y - (y @ x / (x @ x))[:, None] * x if n > 1 else y
        y = y - y.mean(axis=1, keepdims=True)
        out.append((places, np.fft.rfftfreq(n, step), 2.0 / n * np.abs(np.fft.rfft(y * np.hanning(n), axis=1))))
    return out


def segment_spectra(rows: DataFrame, sensors: list[str], step: float = STEP) -> DataFrame:
    """(target, segment_id, sensor, freq, amp) of every segment and sensor that has a spectrum. A call takes TOGETHER segments of a
    target."""
    def run(table: pa.Table) -> pa.Table:
        segment, depth = (table.column(c).to_numpy() for c in ("segment_id", "depth"))
        order = np.argsort(segment, kind="stable")
        ids, begins = np.unique(segment[order], return_index=True)
        parts = [order[a:b] for a, b in zip(begins, [*begins[1:], len(order)], strict=True)]
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for at, s in enumerate(sensors):
            values = table.column(s).to_numpy()
            found = [(i, f[1]) for i, part in enumerate(parts) if (f := even(depth[part], values[part], step)) is not None]
            for places, freq, amp in spectra_of([y for _, y in found], step):
                owners = ids[[found[j][0] for j in places]]
                for held, new in zip(columns, (np.repeat(owners, len(freq)), np.full(amp.size, at), np.tile(freq, len(owners)), amp.ravel()), strict=True):
                    held.append(new)
        segment, sensor, freq, amp = (np.concatenate(c) if c else np.zeros(0) for c in columns)
        target = table.column("target").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(amp), int)))
        names = pa.array(sensors, pa.string()).take(pa.array(sensor.astype(int)))
        return pa.table({"target": target, "segment_id": pa.array(segment.astype(np.int32)), "sensor": names, "freq": pa.array(freq, pa.float64()), "amp": pa.array(amp, pa.float64())})

    wanted = rows.select("target", F.col("segment_id").cast("int").alias("segment_id"), F.col("depth").cast("double").alias("depth"), *[F.col(s).cast("double").alias(s) for s in sensors], F.floor(F.col("segment_id") / TOGETHER).alias("_b"))
    return spread(wanted, "target", "_b").groupBy("target", "_b").applyInArrow(run, f"target {dict(rows.dtypes)['target']}, segment_id int, sensor string, freq double, amp double")


def band_features(spectra: DataFrame, low: float = LOW, high: float = HIGH, bands: tuple[tuple[float, float], ...] = BANDS) -> DataFrame:
    """Normalised band energies, total and log energy, dominant frequency and amplitude, centroid, low over high."""
    inside = spectra.filter(F.col("freq").between(low, high)).withColumn("e", F.col("amp") * F.col("amp"))
    total = F.sum("e")
    names = [F.try_divide(F.sum(F.when((F.col("freq") >= a) & (F.col("freq") < b), F.col("e")).otherwise(0.0)), total).alias(f"band_{i}") for i, (a, b) in enumerate(bands)]
    peak = F.max_by("freq", F.struct("amp", -F.col("freq")))
    share = F.try_divide(F.sum(F.when(F.col("freq") < SPLIT, F.col("e")).otherwise(0.0)), F.nullif(F.sum(F.when(F.col("freq") >= SPLIT, F.col("e")).otherwise(0.0)), F.lit(0.0)))
    return inside.groupBy("target", "segment_id", "sensor").agg(*names, total.alias("total_energy"), F.log1p(total).alias("log_total_energy"), peak.alias("dominant_freq"), F.max("amp").alias("dominant_amp"), F.try_divide(F.sum(F.col("freq") * F.col("e")), total).alias("centroid"), share.alias("low_high_ratio"))


def peaks(spectra: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Peak frequency, wavelength and amplitude of each segment and sensor."""
    peak = F.max_by("freq", F.struct("amp", -F.col("freq")))
    out = spectra.filter(F.col("freq").between(low, high)).groupBy("target", "segment_id", "sensor").agg(peak.alias("peak_frequency"), F.max("amp").alias("peak_amplitude"))
    return out.withColumn("peak_wavelength", F.when(F.col("peak_frequency") > 0, 1 / F.col("peak_frequency")))


def low_pass(df: DataFrame, sensor: str, step: float = STEP, cutoff: float = HIGH) -> DataFrame:
    """(target, depth, value): profiles on an even grid without what oscillates faster than the cutoff."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = even(group["depth"].to_numpy(float), group[sensor].to_numpy(float), step)
        if found is None:
            return pd.DataFrame({"target": [], "depth": [], "value": []})
        grid, y = found
        parts = np.fft.rfft(y - y.mean())
        parts[np.fft.rfftfreq(len(y), step) > cutoff] = 0
        return pd.DataFrame({"target": group["target"].iloc[0], "depth": grid, "value": np.fft.irfft(parts, len(y)) + y.mean()})

    return spread(df.select("target", "depth", sensor), "target").groupBy("target").applyInPandas(run, f"target {dict(df.dtypes)['target']}, depth double, value double")


def frequency_grid(low: float = 0.25, high: float = 5.0, step: float = 0.25) -> np.ndarray:
    return low + step * np.arange(round((high - low) / step) + 1)


def spectrograms(df: DataFrame, sensors: list[str], step: float = 0.05, window: float = 1.0, overlap: float = 0.5, low: float = 0.25, high: float = 5.0, grid_step: float = 0.25) -> DataFrame:
    """(target, sensor, window_depth, freq, power): power densities of Hann windows of a profile, on a fixed grid."""
    grid = frequency_grid(low, high, grid_step)
    size = max(LEAST, round(window / step))
    hop = size - min(round(overlap / step), size - 1)

    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    freq = np.fft.rfftfreq(size, step)
    # each place of the grid between two frequencies; none outside of them
    low_at = np.clip(np.searchsorted(freq, grid, "right") - 1, 0, len(freq) - 2)
    part = (grid - freq[low_at]) / (freq[low_at + 1] - freq[low_at])
    outside = (grid < freq[0]) | (grid > freq[-1])

    def frames(depth: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        found = even(depth, values, step)
        if found is None or len(found[1]) < size:
            return None
        y = detrended(*found)
        starts = np.arange(0, len(y) - size + 1, hop)
        power = np.abs(np.fft.rfft(y[starts[:, None] + np.arange(size)] * hann)) ** 2 * step / (hann**2).sum()
        power[:, 1 : (-1 if size % 2 == 0 else None)] *= 2
        placed = power[:, low_at] + part * (power[:, low_at + 1] - power[:, low_at])
        placed[:, outside] = np.nan
        return found[0][0] + (starts + size / 2) * step, placed

    def run(table: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        depth = table.column("depth").to_numpy()
        for i, s in enumerate(sensors):
            if (found := frames(depth, table.column(s).to_numpy())) is not None:
                at, power = found
                for held, new in zip(columns, (np.full(power.size, i), np.repeat(at, len(grid)), np.tile(grid, len(at)), power.ravel()), strict=True):
                    held.append(new)
        sensor, at, freqs, power = (np.concatenate(c) if c else np.zeros(0) for c in columns)
        target = table.column("target").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(power), int)))
        names = pa.array(sensors, pa.string()).take(pa.array(sensor.astype(int)))
        return pa.table({"target": target, "sensor": names, "window_depth": pa.array(at, pa.float64()), "freq": pa.array(freqs, pa.float64()), "power": pa.array(power, pa.float64())})

    numbers = [F.col(c).cast("double").alias(c) for c in ("depth", *sensors)]
    out = spread(df.select("target", *numbers), "target").groupBy("target").applyInArrow(run, f"target {dict(df.dtypes)['target']}, sensor string, window_depth double, freq double, power double")
    return out.withColumn("power", F.nanvl("power", F.lit(None).cast("double")))


def segment_power(spectra: DataFrame, segs: DataFrame, least_windows: int = 1, normalise: bool = False) -> DataFrame:
    """(target, segment_id, sensor, freq, power, n_windows): mean power of the windows whose centre lies in a segment."""
    # each window once, whatever the frequencies and segments: as samples to their segments
    windows = spectra.groupBy("target", "sensor", F.col("window_depth").alias("depth")).agg(F.collect_list(F.struct("freq", "power")).alias("bins"))
    inside = assign(windows, segs, inclusive=True).select("target", "segment_id", "sensor", F.col("depth").alias("window_depth"), F.explode("bins").alias("b")).select("target", "segment_id", "sensor", "window_depth", "b.freq", "b.power")
    keys = ["target", "segment_id", "sensor"]
    out = inside.groupBy(*keys, "freq").agg(F.avg("power").alias("power"), F.sum("power").alias("_s"), F.count_distinct("window_depth").alias("n_windows"))
    if normalise:
        totals = out.groupBy(*keys).agg(F.sum("_s").alias("_t"))
        out = out.join(totals, keys).withColumn("power", F.when(F.col("_t") > 0, F.col("power") / F.col("_t")).otherwise(F.col("power"))).drop("_t")
    return out.drop("_s").withColumn("power", F.when(F.col("n_windows") >= least_windows, F.col("power")))


def profile_power(df: DataFrame, sensor: str, step: float = STEP) -> DataFrame:
    """(target, freq, power): the squared amplitudes of whole profiles on an even grid, their mean taken off."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = even(group["depth"].to_numpy(float), group[sensor].to_numpy(float), step)
        if found is None:
            return pd.DataFrame({"target": [], "freq": [], "power": []})
        y = found[1]
        return pd.DataFrame({"target": group["target"].iloc[0], "freq": np.fft.rfftfreq(len(y), step), "power": np.abs(np.fft.rfft(y - y.mean())) ** 2})

    return spread(df.select("target", "depth", sensor), "target").groupBy("target").applyInPandas(run, f"target {dict(df.dtypes)['target']}, freq double, power double")


def mean_spectrum(power: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, sensor, freq, power, n): mean power of the segments of each unit at each frequency.
    power: target, segment_id, sensor, freq, power; units: target, segment_id, unit. NULL units are one group."""
    rows = power.join(units.select("target", "segment_id", "unit"), ["target", "segment_id"])
    return rows.groupBy("unit", "sensor", "freq").agg(F.avg("power").alias("power"), F.count("power").alias("n"))
