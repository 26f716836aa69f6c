"""Bayesian online change-point detection, a profile a group.

The forward pass over run lengths and the search for the most probable segmentation are one loop: the segmentation up to a
sample needs the run-length posterior of that sample only, so that memory grows with the length of a profile, not its
square. Runs are held by where they begin, the oldest first, so that a sample changes them in place. The recursion is
sequential in depth; profiles are independent and spread over the cluster.

Time grows with the square of a profile's length, unless runs of less than `least_share` of the posterior are dropped: then
with its length times the runs that are left. What is dropped at one sample is less than least_share times their number.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .clean import spread

LARGEST = 1.0 - 1e-12


class ScalarModel:
    """Normal data with a normal-inverse-gamma prior; a state for each run length. Only means and scales depend on the
    data, so that the log-gamma terms are one table by run length."""

    def __init__(self, n: int, mean: float = 0.0, kappa: float = 1.0, alpha: float = 1.0, beta: float = 0.1):
        self.settings = (kappa, alpha)
        self.prior = (mean, beta)
        self.mean, self.beta, self.run = np.empty(0), np.empty(0), np.empty(0, int)
        self.reserve(n)
        self.mean[0], self.beta[0] = self.prior
        self.size, self.whole = 1, True

    def reserve(self, n: int) -> None:
        """Room for runs of n samples."""
        if n < len(self.mean):
            return
        kappa, alpha = self.settings
        runs = np.arange(n + 1)
        self.kappa, self.alpha = kappa + runs, alpha + runs / 2
        half = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in self.alpha.tolist()])
        self.fixed = half - 0.5 * np.log(2 * np.pi * self.alpha) - 0.5 * np.log((self.kappa + 1) / (self.alpha * self.kappa))
        self.grown = 2 * (self.kappa + 1) / self.kappa
        more = n + 1 - len(self.mean)
        self.mean, self.beta, self.run = (np.concatenate([held, np.zeros(more, held.dtype)]) for held in (self.mean, self.beta, self.run))

    def _of(self, table: np.ndarray) -> np.ndarray:
        """A table by run length for the runs at hand, the oldest first."""
        return table[self.size - 1 :: -1] if self.whole else table[self.run[: self.size]]

    def log_densities(self, x: float) -> np.ndarray:
        """By run, the oldest first."""
        k = self.size
        off = (x - self.mean[:k]) ** 2
        return self._of(self.fixed) - 0.5 * np.log(self.beta[:k]) - (self._of(self.alpha) + 0.5) * np.log1p(off / (self._of(self.grown) * self.beta[:k]))

    def log_density(self, x: float) -> np.ndarray:
        """By run length."""
        return self.log_densities(x)[::-1]

    def learn(self, x: float) -> None:
        k = self.size
        kappa = self._of(self.kappa)
        off = (x - self.mean[:k]) / (kappa + 1)
        self.beta[:k] += 0.5 * kappa * (kappa + 1) * off * off
        self.mean[:k] += off
        if not self.whole:
            self.run[:k] += 1
            self.run[k] = 0
        self.mean[k], self.beta[k] = self.prior
        self.size += 1

    def keep(self, runs: np.ndarray, lengths: np.ndarray) -> None:
        """Only these runs (places, the oldest first), of these lengths."""
        for held in (self.mean, self.beta):
            held[: len(runs)] = held[runs]
        self.run[: len(runs)] = lengths
        self.size, self.whole = len(runs), False


class VectorModel:
    """Normal vectors with a normal-inverse-Wishart prior. Inverses and determinants of the scale matrices follow each
    rank-one change, which costs d * d for each run length."""

    def __init__(self, n: int, mean: np.ndarray, spread: np.ndarray, kappa: float = 1.0, nu: float | None = None):
        d = len(mean)
        runs = np.arange(n + 1)
        self.d, self.kappa, self.nu = d, kappa + runs, (d + 2 if nu is None else nu) + runs
        df = self.nu - d + 1
        self.fixed = np.array([math.lgamma((f + d) / 2) - math.lgamma(f / 2) - d / 2 * math.log(f * math.pi) for f in df])
        self.prior = (mean, np.linalg.inv(spread), np.linalg.slogdet(spread)[1])
        # by run, the newest first, with the length of each
        self.mean, self.inverse, self.logdet, self.run = mean[None, :], self.prior[1][None], np.array([self.prior[2]]), np.zeros(1, int)

    def _forms(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        off = x - self.mean
        turned = np.einsum("kij,kj->ki", self.inverse, off)
        return off, turned, np.einsum("ki,ki->k", off, turned)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        d = self.d
        kappa, df = self.kappa[self.run], self.nu[self.run] - d + 1
        grown = (kappa + 1) / (kappa * df)
        distance = self._forms(x)[2] / grown
        return self.fixed[self.run] - 0.5 * (self.logdet + d * np.log(grown)) - (df + d) / 2 * np.log1p(distance / df)

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        return self.log_density(x)[::-1]

    def keep(self, runs: np.ndarray, lengths: np.ndarray) -> None:
        """Only these runs (places, the oldest first), of these lengths: what is held of each is d * d numbers."""
        at = (len(self.mean) - 1 - runs)[::-1]
        self.mean, self.inverse, self.logdet, self.run = self.mean[at], self.inverse[at], self.logdet[at], lengths[::-1].astype(int)

    def learn(self, x: np.ndarray) -> None:
        kappa = self.kappa[self.run]
        off, turned, form = self._forms(x)
        c = kappa / (kappa + 1)
        inverse = self.inverse - (c / (1 + c * form))[:, None, None] * turned[:, :, None] * turned[:, None, :]
        mean = self.mean + off / (kappa + 1)[:, None]
        self.mean = np.concatenate([self.prior[0][None], mean])
        self.inverse = np.concatenate([self.prior[1][None], inverse])
        self.logdet = np.concatenate([[self.prior[2]], self.logdet + np.log1p(c * form)])
        self.run = np.concatenate([[0], self.run + 1])


@dataclass
class Detection:
    boundaries: np.ndarray  # sample indexes where a segment begins
    p_change: np.ndarray  # probability of run length 0 at each sample
    run: np.ndarray  # most probable run length at each sample
    log_evidence: float


def _log_sum(x: np.ndarray) -> float:
    top = float(x.max()) if len(x) else -math.inf
    return top + math.log(float(np.exp(x - top).sum())) if top > -math.inf else -math.inf


def separated(indexes: list[int], least: int) -> list[int]:
    """From the left, those at least so far behind the last one kept."""
    kept: list[int] = []
    for i in indexes:
        if not kept or i - kept[-1] >= least:
            kept.append(i)
    return kept


#: What Recursion.held() gives, as columns.
STATE = "t long, best double, evidence double, log_run array<double>, before array<double>, begins array<long>, mean array<double>, beta array<double>, ends array<long>, origins array<long>"


class Recursion:
    """The forward pass and the best segmentation so far, a sample at a time. Everything is held by run, the oldest first: where it
    begins (from 1; 0 before the first sample), its log share, and the log probability of the best segmentation before it. Of
    the segmentations only those are kept that some run still leads to, which soon share all but their last boundaries."""

    def __init__(self, model, least_run: int = 0, least_share: float = 0.0, capacity: int = 64):
        self.model, self.least_run, self.least_share = model, least_run, least_share
        self.log_run, self.before, self.begins = np.zeros(capacity + 1), np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
        self.k, self.t = 1, 0
        self.best, self.evidence = 0.0, 0.0
        self.origin: dict[int, int] = {}  # of the best segmentation of the first z samples: where its last segment begins

    def reserve(self, n: int) -> None:
        """Room for n runs."""
        more = n + 1 - len(self.log_run)
        if more > 0:
            self.log_run = np.concatenate([self.log_run, np.zeros(more)])
            self.before = np.concatenate([self.before, np.full(more, -np.inf)])
            self.begins = np.concatenate([self.begins, np.zeros(more, np.int64)])

    def step(self, x, base: float, posterior: Callable[[int, np.ndarray, np.ndarray], None] | None = None) -> tuple[float, int]:
        """Take a sample with its hazard: the probability that it begins a segment, and the most probable run length."""
        k, z = self.k, self.t + 1
        log_run, begins, before = self.log_run, self.begins, self.before
        log_run[:k] += self.model.log_densities(x)
        # runs of at least least_run may end here
        able = k if not self.least_run else int(np.searchsorted(begins[:k], z - min(self.least_run, z), "left"))
        fresh = _log_sum(log_run[:able]) + math.log(base) if base > 0 and able else -math.inf
        log_run[:able] += math.log1p(-base)
        log_run[k], begins[k] = fresh, z
        k += 1
        self.evidence = _log_sum(log_run[:k])
        share = np.exp(log_run[:k] - self.evidence)
        p_change, run = float(share[-1]), int(z - begins[k - 1 - int(share[::-1].argmax())])
        if posterior:
            posterior(self.t, z - begins[:k], share)
        logs = np.log(share)
        first = 1 if begins[0] == 0 else 0  # the segmentation without an end is considered last
        paths = logs[first:-1] + before[first : k - 1]
        j = int(paths.argmax()) if len(paths) else -1
        whole = float(logs[0]) if first else -math.inf
        last, best, origin = self.best, -math.inf, 0
        if j >= 0 and paths[j] >= whole and paths[j] > -math.inf:
            best, origin = float(paths[j]), int(begins[first + j])
        elif whole > -math.inf:
            best = whole
        before[k - 1] = logs[-1] + last
        self.best = best
        if origin:
            self.origin[z] = origin
        self.model.learn(x)
        if self.least_share and self.t % 32 == 31:
            kept = np.flatnonzero(share >= self.least_share)
            if len(kept) < 0.75 * k:
                kept = kept if len(kept) and kept[-1] == k - 1 else np.append(kept, k - 1)
                self.model.keep(kept, z - begins[kept])
                for held in (log_run, begins, before):
                    held[: len(kept)] = held[kept]
                k = len(kept)
                self.prune(k, z)
        self.k, self.t = k, z
        return p_change, run

    def prune(self, k: int, z: int) -> None:
        """Forget segmentations that no run leads to."""
        reached: dict[int, int] = {}
        for end in [z, *(int(b) - 1 for b in self.begins[:k])]:
            while end > 0 and end not in reached and end in self.origin:
                reached[end] = self.origin[end]
                end = reached[end] - 1  # noqa: PLW2901
        self.origin = reached

    def held(self) -> tuple:
        """What it takes to go on from here with a scalar model (STATE): a row of numbers and lists."""
        k, m = self.k, self.model
        self.prune(k, self.t)
        lists = [self.log_run[:k], self.before[:k], self.begins[:k], m.mean[:k], m.beta[:k]]
        return (self.t, self.best, self.evidence, *[v.tolist() for v in lists], list(self.origin), list(self.origin.values()))

    def go_on(self, held: tuple, samples: int) -> None:
        """Continue from held(), with room for so many more samples."""
        self.t, self.best, self.evidence, log_run, before, begins, mean, beta, ends, origins = held
        k = self.k = len(log_run)
        self.origin = dict(zip(map(int, ends), map(int, origins), strict=True))
        self.reserve(k + samples)
        self.model.reserve(max(self.t - int(begins[0]), k) + samples)
        for to, values in ((self.log_run, log_run), (self.before, before), (self.begins, begins), (self.model.mean, mean), (self.model.beta, beta)):
            to[:k] = values
        self.model.size, self.model.whole = k, False
        self.model.run[:k] = self.t - self.begins[:k]

    def boundaries(self) -> list[int]:
        """Samples, from 0, where the segments of the best segmentation begin."""
        found, z = [], self.t
        while z > 0 and self.origin.get(z):
            found.append(self.origin[z] - 1)
            z = self.origin[z] - 1
        return found[::-1]


def detect(x: np.ndarray, model, hazard: np.ndarray, least_run: int = 0, factors: tuple[np.ndarray, ...] = (), posterior: Callable[[int, np.ndarray, np.ndarray], None] | None = None, least_share: float = 0.0) -> Detection:
    """Run the recursion over samples x with a hazard for each sample, 0 for run lengths below least_run. `posterior` is
    called with each sample's place, run lengths and their shares."""
    n = len(x)
    base = np.clip(hazard, 0.0, LARGEST)
    for f in factors:
        base = np.clip(base * f, 0.0, LARGEST)
    recursion = Recursion(model, least_run, least_share, n)
    p_change, runs = np.zeros(n), np.zeros(n, np.int64)
    with np.errstate(divide="ignore"):
        for t, h in enumerate(base.tolist()):
            p_change[t], runs[t] = recursion.step(x[t], h, posterior)
    return Detection(np.array(recursion.boundaries(), np.int64), p_change, runs, recursion.evidence)


#: Samples times runs that are held for profiles at once: enough to spread numpy's cost a call, little enough for a cache.
TOGETHER = 1 << 14


def _row_sums(x: np.ndarray) -> np.ndarray:
    """_log_sum() of each row."""
    top = x.max(axis=1)
    safe = np.where(top > -np.inf, top, 0.0)
    return np.where(top > -np.inf, safe + np.log(np.exp(x - safe[:, None]).sum(axis=1)), -np.inf)


def _detect_rows(signals: list[np.ndarray], bases: list[np.ndarray], means: np.ndarray, prior: tuple[float, float, float], least_run: int) -> list[Detection]:
    """detect() of scalar profiles, the longest first, under one least run: each sample is a step of all profiles that have it. Runs
    are never dropped, so that at every sample all have the same ones, and a row's arithmetic is that of Recursion."""
    kappa, alpha, beta = prior
    lengths = np.array([len(x) for x in signals])
    count, n = len(signals), int(lengths[0])
    table = ScalarModel(n, 0.0, kappa, alpha, beta)
    values, hazard = np.zeros((n, count)), np.zeros((n, count))
    for i, (x, h) in enumerate(zip(signals, bases, strict=True)):
        values[: len(x), i], hazard[: len(x), i] = x, h
    log_hazard, log_rest = np.log(hazard), np.log1p(-hazard)
    mean, scale = np.empty((count, n + 1)), np.full((count, n + 1), beta)
    mean[:] = means[:, None]
    log_run, before, origin = np.zeros((count, n + 1)), np.full((count, n + 1), -np.inf), np.zeros((count, n + 1), np.int64)
    p_change, runs = np.zeros((count, n)), np.zeros((count, n), np.int64)
    last, evidence = np.zeros(count), np.zeros(count)
    for z in range(1, n + 1):
        a = int(np.searchsorted(-lengths, -z, "right"))  # profiles with a sample here
        at = np.arange(a)
        x, m, b = values[z - 1, :a, None], mean[:a, :z], scale[:a, :z]
        own_kappa, own_alpha = table.kappa[z - 1 :: -1], table.alpha[z - 1 :: -1]
        off = x - m
        logs = log_run[:a, :z]
        logs += table.fixed[z - 1 :: -1] - 0.5 * np.log(b) - (own_alpha + 0.5) * np.log1p(off**2 / (table.grown[z - 1 :: -1] * b))
        able = z - min(least_run, z) if least_run else z
        fresh = _row_sums(logs[:, :able]) + log_hazard[z - 1, :a] if able else np.full(a, -np.inf)
        logs[:, :able] += log_rest[z - 1, :a, None]
        log_run[:a, z] = fresh
        evidence[:a] = _row_sums(log_run[:a, : z + 1])
        share = np.exp(log_run[:a, : z + 1] - evidence[:a, None])
        p_change[:a, z - 1], runs[:a, z - 1] = share[:, -1], share[:, ::-1].argmax(axis=1)
        logs = np.log(share)
        best = logs[:, 0].copy()
        if z > 1:
            paths = logs[:, 1:z] + before[:a, 1:z]
            j = paths.argmax(axis=1)
            found = paths[at, j]
            cut = (found >= best) & (found > -np.inf)
            best[cut] = found[cut]
            origin[:a, z] = np.where(cut, j + 1, 0)
        before[:a, z] = logs[:, z] + last[:a]
        last[:a] = best
        off /= own_kappa + 1
        b += 0.5 * own_kappa * (own_kappa + 1) * off * off
        m += off
    out = []
    for i, size in enumerate(lengths.tolist()):
        at, z = [], size
        while z > 0 and origin[i, z]:
            at.append(int(origin[i, z]) - 1)
            z = at[-1]
        out.append(Detection(np.array(at[::-1], np.int64), p_change[i, :size].copy(), runs[i, :size].copy(), float(evidence[i])))
    return out


def detect_all(signals: list[np.ndarray], means: list[float], hazards: list[np.ndarray], least_runs: list[int], factors: list[tuple[np.ndarray, ...]], prior: tuple[float, float, float]) -> list[Detection]:
    """detect() of many profiles of one sensor, in their order: those of one least run and about one length go together."""
    bases = []
    for h, more in zip(hazards, factors, strict=True):
        base = np.clip(h, 0.0, LARGEST)
        for f in more:
            base = np.clip(base * f, 0.0, LARGEST)
        bases.append(base)
    order = sorted(range(len(signals)), key=lambda i: (least_runs[i], -len(signals[i])))
    found: list[Detection] = [Detection(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), 0.0)] * len(signals)
    start = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        while start < len(order):
            first = order[start]
            most = max(1, TOGETHER // max(1, len(signals[first])))
            some = [i for i in order[start : start + most] if least_runs[i] == least_runs[first]]
            start += len(some)
            if len(signals[first]):
                some = [i for i in some if len(signals[i])]
                done = _detect_rows([signals[i] for i in some], [bases[i] for i in some], np.array([means[i] for i in some]), prior, least_runs[first])
                for i, d in zip(some, done, strict=True):
                    found[i] = d
    return found


def drops(run: np.ndarray, least_drop: int = 5) -> list[int]:
    """Samples where the most probable run length falls by so much."""
    return (np.flatnonzero(run[:-1] - run[1:] >= least_drop) + 1).tolist() if len(run) > 1 else []


def odd_window(wanted: int, n: int) -> int:
    """The largest odd window up to the wanted one that fits n samples; 0 if none of three fits."""
    size = min(int(wanted), n)
    size -= 1 - size % 2
    return size if size >= 3 else 0


def savitzky_golay(x: np.ndarray, window: int, degree: int = 3) -> np.ndarray:
    """Least-squares smoothing by a moving polynomial; the ends follow the polynomial of the first and last window."""
    half = window // 2
    place = np.arange(-half, half + 1.0)
    fit = np.linalg.pinv(np.vander(place, degree + 1, increasing=True))
    out = np.convolve(x, fit[0][::-1], "same").astype(float)
    ends = np.vander(place, degree + 1, increasing=True)
    out[:half] = (ends @ (fit @ x[:window]))[:half]
    out[-half:] = (ends @ (fit @ x[-window:]))[-half:]
    return out


def total_variation(x: np.ndarray, weight: float, steps: int = 50, rate: float = 0.249) -> np.ndarray:
    """Total-variation denoising by projected gradient steps on the dual."""
    dual = np.zeros(max(0, len(x) - 1))
    for _ in range(steps):
        now = x + weight * np.diff(dual, prepend=0, append=0)
        dual = np.clip(dual + rate * np.diff(now), -1, 1)
    return x + weight * np.diff(dual, prepend=0, append=0)


#: Roughness below which nothing is smoothed and from which smoothing is full, and the weight and the window
#: in depth units at either.
SMOOTH_FROM, SMOOTH_FULL = 0.080, 0.150
WEIGHTS, WINDOWS = (0.05, 0.30), (0.30, 1.00)


def adaptive_smooth(x: np.ndarray, step: float, kind: str = "tv", most: float = WEIGHTS[1]) -> np.ndarray:
    """Smooth rough signals only, the more the rougher, by total variation (of weight `most` at most) or a moving
    polynomial."""
    rough = float(np.std(np.diff(x))) if len(x) > 1 else 0.0
    if rough < SMOOTH_FROM:
        return x
    share = min(1.0, (rough - SMOOTH_FROM) / (SMOOTH_FULL - SMOOTH_FROM))
    between = lambda ends: ends[0] + share * (ends[1] - ends[0])
    if kind == "tv":
        return total_variation(x, between((WEIGHTS[0], most)))
    if kind != "savgol":
        raise ValueError(f"unknown smoothing: {kind}")
    size = odd_window(max(5, round(between(WINDOWS) / step) | 1), len(x))
    return savitzky_golay(x, size, min(3, size - 1)) if size else x


def fill(x: np.ndarray) -> np.ndarray:
    """Missing samples interpolated by place; zeros if all are missing."""
    good = np.isfinite(x)
    if good.all() or not good.any():
        return np.where(good, x, 0.0)
    return np.interp(np.arange(len(x)), np.flatnonzero(good), x[good])


def standard(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)


RESULT = "target string, boundary_index long, boundary_depth double, p_change double, n long, log_evidence double"


@dataclass
class Profile:
    """The samples of a group in order of depth."""

    target: str
    depth: np.ndarray
    columns: dict[str, np.ndarray]

    @classmethod
    def of(cls, table: pa.Table) -> Profile:
        depth = table.column("depth").to_numpy()
        order = np.argsort(depth, kind="stable")
        others = {c: np.asarray(table.column(c).to_numpy(), float)[order] for c in table.column_names if c not in ("target", "depth")}
        return cls(str(table.column("target")[0].as_py()), depth[order], others)

    @property
    def step(self) -> float:
        return float(np.median(np.diff(self.depth))) if len(self.depth) > 1 else 0.02


def _signal(p: Profile, sensor: str, smooth: str | None) -> np.ndarray:
    x = fill(p.columns[sensor])
    return adaptive_smooth(x, p.step, smooth) if smooth else x


def _hazards(p: Profile) -> tuple[np.ndarray, int, tuple[np.ndarray, ...]]:
    """Hazard (NULL: 1 / n), least run and factors of a profile."""
    n = len(p.depth)
    h = p.columns.get("h", np.full(n, np.nan))
    least = int(p.columns["least_run"][0]) if "least_run" in p.columns else 0
    return np.where(np.isfinite(h), h, 1 / max(n, 1)), least, (p.columns["factor"],) if "factor" in p.columns else ()


def run_profile(p: Profile, sensors: list[str], mean_from_signal: bool, kappa: float, alpha: float, beta: float, smooth: str | None, posterior=None, least_share: float = 0.0) -> Detection:
    """The detection of one profile: one sensor by its signal, several as standardised vectors."""
    n = len(p.depth)
    h, least, factors = _hazards(p)
    if len(sensors) == 1:
        x = _signal(p, sensors[0], smooth)
        model = ScalarModel(n, float(np.median(x)) if mean_from_signal else 0.0, kappa, alpha, beta)
    else:
        x = standard(np.stack([fill(p.columns[s]) for s in sensors], axis=1))
        spread_ = (np.cov(x, rowvar=False) if n > 1 else np.zeros((x.shape[1],) * 2)) + 1e-6 * np.eye(x.shape[1])
        model = VectorModel(n, np.zeros(x.shape[1]), spread_, kappa)
    return detect(x, model, h, least, factors, posterior, least_share)


def run_profiles(profiles: list[Profile], sensors: list[str], mean_from_signal: bool, kappa: float, alpha: float, beta: float, smooth: str | None, least_share: float = 0.0) -> list[Detection]:
    """run_profile() of many: those of one sensor that keep all runs go through the recursion together."""
    if len(sensors) > 1 or least_share:
        return [run_profile(p, sensors, mean_from_signal, kappa, alpha, beta, smooth, None, least_share) for p in profiles]
    signals = [_signal(p, sensors[0], smooth) for p in profiles]
    means = [float(np.median(x)) if mean_from_signal else 0.0 for x in signals]
    specs = [_hazards(p) for p in profiles]
    return detect_all(signals, means, [h for h, _, _ in specs], [least for _, least, _ in specs], [f for _, _, f in specs], (kappa, alpha, beta))


#: Samples of whole profiles that a task holds at once, or one profile's.
HELD_ROWS = 1 << 16


def profile_batches(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("target",)) -> Iterator[list[pa.Table]]:
    """Whole profiles from a partition's rows sorted by `keys`, a few at a time."""
    rest, held, size = [], [], 0
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        named = [batch.column(k) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in named:
            new[1:] |= ~np.asarray(pc.equal(c.slice(1), c.slice(0, batch.num_rows - 1)).fill_null(False))
        bounds = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(bounds):
            key = tuple(c[a].as_py() for c in named)
            if rest and key != last:
                held.append(pa.Table.from_batches(rest))
                rest = []
                if size >= HELD_ROWS:
                    yield held
                    held, size = [], 0
            rest.append(batch.slice(a, b - a))
            size += b - a
            last = key
    if rest:
        held.append(pa.Table.from_batches(rest))
    if held:
        yield held


def _spec(df: DataFrame, sensors: list[str]) -> DataFrame:
    columns = [c for c in ("h", "least_run", "factor") if c in df.columns]
    return spread(df.select("target", df["depth"].cast("double").alias("depth"), *[df[s].cast("double").alias(s) for s in sensors], *columns), "target")


def change_points(df: DataFrame, sensors: list[str], mean_from_signal: bool = True, kappa: float = 1.0, alpha: float = 1.0, beta: float = 0.1, min_separation: int = 1, method: str = "map", smooth: str | None = None, least_share: float = 0.0) -> DataFrame:
    """Change points of every profile: a row each, and one with NULLs for a profile without any.

    df: target, depth, the sensors, and from the hazard spec the columns h (NULL: 1 / n), least_run and factor, each
    optional. One sensor: its signal, centred at its median; several: standardised vectors. Points closer than `min_separation` or
    least_run behind one that is kept are left out. One shuffle by target.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tables in profile_batches(batches):
            profiles = [Profile.of(t) for t in tables]
            rows = []
            for p, found in zip(profiles, run_profiles(profiles, sensors, mean_from_signal, kappa, alpha, beta, smooth, least_share), strict=True):
                least = int(p.columns["least_run"][0]) if "least_run" in p.columns else 1
                at = separated(found.boundaries.tolist() if method == "map" else drops(found.run), max(min_separation, least, 1))
                rows += [(p.target, i, float(p.depth[i]), float(found.p_change[i]), len(p.depth), found.log_evidence) for i in at] or [(p.target, None, None, None, len(p.depth), found.log_evidence)]
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_pydict({c.split()[0]: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(zip(RESULT.split(", "), kinds, strict=True))})

    return _spec(df, sensors).sortWithinPartitions("target").mapInArrow(run, RESULT)


def posteriors(df: DataFrame, sensors: list[str], floor: float = 1e-6, **settings) -> DataFrame:
    """(target, depth, i, run, p): the run-length posterior of every sample, shares from the floor on."""
    settings = {"mean_from_signal": True, "kappa": 1.0, "alpha": 1.0, "beta": 0.1, "smooth": None} | settings

    def run(table: pa.Table) -> pa.Table:
        p, places, lengths, shares = Profile.of(table), [], [], []

        def take(t: int, run: np.ndarray, share: np.ndarray) -> None:
            kept = share >= floor
            places.append(np.full(int(kept.sum()), t))
            lengths.append(run[kept])
            shares.append(share[kept])

        run_profile(p, sensors, posterior=take, **settings)
        at = np.concatenate(places)
        return pa.table({"target": pa.array([p.target] * len(at)), "depth": p.depth[at], "i": at, "run": np.concatenate(lengths), "p": np.concatenate(shares)})

    return _spec(df, sensors).groupBy("target").applyInArrow(run, "target string, depth double, i long, run long, p double")
