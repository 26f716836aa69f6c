"""Online change-point detection on a stream of samples: the recursion of the batch detector, a state a target.

The state holds the run-length distribution, cut below a share, and the model's sufficient statistics for the run lengths
kept, so that it stays small however long a profile is. A change is reported when the most probable run length falls.
Samples of a target must arrive in order of depth within a micro-batch or later; late ones (not deeper than the last) are
dropped, as a recursion can't go back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "target string, depth double, run long, p_change double, changed boolean"
STATE = "depth double, run long, r array<long>, w array<double>, mean array<double>, beta array<double>"


def advance(state: tuple, x: float, hazard: float, prior: tuple[float, float, float, float], least_share: float) -> tuple:
    """One sample: run lengths r, their shares w, means and betas by run length; the same, and the share of a change."""
    r, w, mean, beta = state
    mean0, kappa0, alpha0, beta0 = prior
    kappa, alpha = kappa0 + r, alpha0 + r / 2
    scale = beta * (kappa + 1) / (alpha * kappa)
    lg = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in alpha])
    logs = np.log(w) + lg - 0.5 * np.log(2 * np.pi * alpha * scale) - (alpha + 0.5) * np.log1p((x - mean) ** 2 / (2 * alpha * scale))
    joint = np.exp(logs - logs.max())
    shares = np.concatenate([[hazard * joint.sum()], (1 - hazard) * joint])
    shares /= shares.sum()
    beta2 = beta + 0.5 * kappa * (x - mean) ** 2 / (kappa + 1)
    new = np.concatenate([[0], r + 1]), np.concatenate([[mean0], (kappa * mean + x) / (kappa + 1)]), np.concatenate([[beta0], beta2])
    keep = shares >= least_share
    keep[0] = True
    kept = shares[keep] / shares[keep].sum()
    return new[0][keep], kept, new[1][keep], new[2][keep], float(shares[0])


def detect_online(stream: DataFrame, value: str, kappa: float = 250.0, prior: tuple[float, float, float, float] = (0.0, 1.0, 1.0, 0.1), least_share: float = 1e-6, least_drop: int = 5) -> DataFrame:
    """target, depth, run, p_change and changed for every sample of a stream (target, depth, value)."""
    hazard = 1.0 / max(kappa, 1.0)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            last, longest, r, w, mean, beta = state.get
            now = tuple(np.array(v) for v in (r, w, mean, beta))
        else:
            last, longest = -math.inf, 0
            now = (np.zeros(1, np.int64), np.ones(1), np.array([prior[0]]), np.array([prior[3]]))
        rows = []
        for depth, x in pd.concat(list(batches)).sort_values("depth")[["depth", "x"]].itertuples(index=False):
            if depth <= last or not math.isfinite(x):
                continue
            *now, p = advance(tuple(now), x, hazard, prior, least_share)
            best = int(now[0][now[1].argmax()])
            rows.append((str(key[0]), depth, best, p, longest - best >= least_drop))
            last, longest = depth, best
        state.update((last, longest, *[v.tolist() for v in now]))
        yield pd.DataFrame(rows, columns=["target", "depth", "run", "p_change", "changed"])

    from pyspark.sql import functions as F

    rows = stream.select("target", F.col("depth").cast("double").alias("depth"), F.col(value).cast("double").alias("x"))
    return rows.groupBy("target").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_means(stream: DataFrame, time: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean and number of values by target and time window, with a watermark for late rows."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time, late).groupBy("target", F.window(time, window)).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select("target", F.col("window.start").alias("start"), "mean", "n")
