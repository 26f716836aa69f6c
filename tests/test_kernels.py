"""Numeric kernels against plain forms of the same definitions."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from profseg.operators import detect, model, selection, spectral


def matrix_map(x, model_of, hazard, least_run):
    """The segmentation from the whole run-length posterior, kept as a matrix."""
    n, m = len(x), model_of()
    post = np.zeros((n, n + 1))
    logs = np.zeros(1)
    for t in range(n):
        joint = logs + m.log_density(x[t])
        h = np.where(np.arange(t + 1) < least_run, 0.0, hazard)
        with np.errstate(divide="ignore"):
            reset = joint + np.log(h)
        logs = np.concatenate([[np.logaddexp.reduce(reset)], joint + np.log1p(-h)])
        post[t, : t + 2] = np.exp(logs - np.logaddexp.reduce(logs))
        m.learn(x[t])
    assert np.allclose(post.sum(axis=1), 1)
    with np.errstate(divide="ignore"):
        lp = np.log(post)
    best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for z in range(1, n + 1):
        options = [(lp[z - 1, z - j] + lp[j - 1, 0] + best[j - 1], j) for j in range(1, z)] + [(lp[z - 1, z], 0)]
        top = max(o[0] for o in options)
        if np.isfinite(top):
            best[z], back[z] = top, next(j for v, j in options if v == top)
    out, z = [], n
    while z > 0 and back[z]:
        out.append(back[z] - 1)
        z = back[z] - 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("least", [0, 5])
def test_fused_segmentation(seed, least):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(level, 0.1, rng.integers(5, 40)) for level in rng.uniform(1.5, 3.5, 4)])
    make = lambda: detect.ScalarModel(len(x), float(np.median(x)))
    found = detect.detect(x, make(), np.full(len(x), 0.02), least)
    assert found.boundaries.tolist() == matrix_map(x, make, 0.02, least)


def test_finds_levels():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(v, 0.1, 60) for v in (1.5, 3.0, 2.0)])
    found = detect.detect(x, detect.ScalarModel(len(x), 2.0), np.full(len(x), 1 / len(x)))
    assert [round(b / 60) for b in found.boundaries] == [1, 2]
    assert np.abs(found.boundaries - [60, 120]).max() <= 2


@pytest.mark.parametrize("n", [0, 1, 2])
def test_short_profiles(n):
    assert detect.detect(np.ones(n), detect.ScalarModel(n, 1.0), np.full(n, 0.1)).boundaries.tolist() == []


def test_vector_model_equals_plain():
    rng = np.random.default_rng(2)
    x, spread = rng.normal(size=(12, 3)), np.eye(3) * 0.7
    m = detect.VectorModel(12, np.zeros(3), spread)
    for row in x[:-1]:
        m.learn(row)
    lam, nu, v, mu = 1.0, 5.0, spread.copy(), np.zeros(3)
    for row in x[:-1]:
        v = v + lam / (lam + 1) * np.outer(row - mu, row - mu)
        mu, lam, nu = (lam * mu + row) / (lam + 1), lam + 1, nu + 1
    df = nu - 2
    scale = v * (lam + 1) / (lam * df)
    q = (x[-1] - mu) @ np.linalg.solve(scale, x[-1] - mu)
    expected = math.lgamma((df + 3) / 2) - math.lgamma(df / 2) - 1.5 * math.log(df * math.pi) - 0.5 * np.linalg.slogdet(scale)[1] - (df + 3) / 2 * math.log1p(q / df)
    assert m.log_density(x[-1])[-1] == pytest.approx(expected)


def test_savitzky_golay_keeps_cubics():
    t = np.linspace(-1, 2, 41)
    assert np.allclose(detect.savitzky_golay(t**3 - t, 11, 3), t**3 - t)


def test_total_variation_flattens():
    rng = np.random.default_rng(3)
    x = np.repeat([0.0, 5.0], 50) + rng.normal(0, 0.1, 100)
    y = detect.total_variation(x, 0.3)
    assert np.std(np.diff(y)[:40]) < np.std(np.diff(x)[:40]) and y[:40].mean() < 1 < 4 < y[60:].mean()


def test_spectrum_peak():
    depth = np.arange(0, 20, 0.02)
    freq, amp = spectral.spectrum(depth, np.sin(2 * np.pi * 1.5 * depth) + 0.3 * depth, 0.02)
    assert freq[amp.argmax()] == pytest.approx(1.5, abs=0.05)
    assert spectral.spectrum(depth[:5], depth[:5], 0.02) is None


def test_ward_on_blobs():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (10, 2)) for c in (0, 5, 9)])
    assert model.ward(x, 3).tolist() == [0] * 10 + [1] * 10 + [2] * 10
    assert model.ward(x[:1], 3).tolist() == [0] and model.ward(x[:0], 2).tolist() == []


def test_smoothing_lowers_energy():
    unary = np.array([[0.0, 1.0], [0.6, 0.5], [0.0, 1.0]])
    edges = [(0, 1, 1.0), (1, 2, 1.0)]
    assert model.smooth_labels(unary, edges, 0.0).tolist() == [0, 1, 0]
    assert model.smooth_labels(unary, edges, 1.0).tolist() == [0, 0, 0]


def test_run_length_drops():
    run = np.array([0, 1, 2, 3, 4, 5, 6, 0, 1, 2, 0, 1, 2, 3, 4, 5, 0])
    assert detect.drops(run) == [7, 16] and detect.drops(run, 2) == [7, 10, 16] and detect.drops(run[:1]) == []
    assert detect.separated([3, 5, 9, 20], 5) == [3, 9, 20]


@pytest.mark.parametrize("window", [5, 9, 15])
def test_savitzky_golay_fits_polynomials(window):
    x, half = np.random.default_rng(8).normal(0, 1, 40), window // 2
    got = detect.savitzky_golay(x, window)
    place = np.arange(window) - half
    for i in range(len(x)):
        begin = min(max(i - half, 0), len(x) - window)
        fit = np.polyfit(place, x[begin : begin + window], 3)
        assert got[i] == pytest.approx(np.polyval(fit, i - begin - half), abs=1e-8)


def test_total_variation_nears_its_optimum():
    x = np.concatenate([np.full(30, 0.0), np.full(30, 1.0)]) + np.random.default_rng(9).normal(0, 0.2, 60)
    cost = lambda u: 0.5 * ((u - x) ** 2).sum() + 0.3 * np.abs(np.diff(u)).sum()
    best = cost(detect.total_variation(x, 0.3, 20_000))
    assert best <= cost(detect.total_variation(x, 0.3)) <= 1.1 * best < cost(x)


def test_smoothing_ramps():
    calm, rough = np.sin(np.arange(200) / 40), np.sin(np.arange(200) / 40) + np.random.default_rng(10).normal(0, 0.3, 200)
    for kind in ("tv", "savgol"):
        assert detect.adaptive_smooth(calm, 0.02, kind) is calm
        assert np.diff(detect.adaptive_smooth(rough, 0.02, kind)).std() < 0.5 * np.diff(rough).std()
    assert np.diff(detect.adaptive_smooth(rough, 0.02, "tv", 0.1)).std() > np.diff(detect.adaptive_smooth(rough, 0.02, "tv")).std()
    with pytest.raises(ValueError, match="unknown smoothing"):
        detect.adaptive_smooth(rough, 0.02, "other")
    assert [detect.odd_window(w, 50) for w in (2, 3, 8, 51, 99)] == [0, 3, 7, 49, 49]


def test_pca_and_centres(spark):
    x = np.random.default_rng(11).normal(0, [3, 2, 1, 0.5], (60, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    got = np.array([r.x for r in model.pca(df, 2).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]))
    centres, inertia = model.kmeans(df, 4, seed=1, starts=2)
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert [r.cluster_id for r in model.predict(df, centres).orderBy("id").collect()] == d.argmin(axis=1).tolist()
    assert inertia == pytest.approx(d.min(axis=1).sum())


def test_mixture_steps_equal_plain_em(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(v, 1, (40, 2)) for v in (0, 5)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    for kind in ("full", "tied", "diag", "spherical"):
        m = model.mixture(df, 2, kind, seed=1, tolerance=1e-10, turns=200)
        logs = m.log_parts(x)
        r = np.exp(logs - np.logaddexp.reduce(logs, axis=1)[:, None])
        assert np.allclose(m.weights, r.mean(axis=0), atol=1e-4) and np.allclose(m.means, (r.T @ x) / r.sum(axis=0)[:, None], atol=1e-3)
        assert m.log_likelihood == pytest.approx(np.logaddexp.reduce(logs, axis=1).sum(), abs=1e-3)


def test_band_energies_of_a_sine(spark):
    depth = np.arange(0, 10, 0.02)
    rows = spark.createDataFrame([("a", 0, float(d), float(np.sin(2 * np.pi * 1.5 * d) + 0.1 * d)) for d in depth], "target string, segment_id int, depth double, x double")
    spectra = spectral.segment_spectra(rows, ["x"])
    got = spectral.band_features(spectra).first()
    assert got.band_1 > 0.99 and got.dominant_freq == pytest.approx(1.5, abs=0.1) and got.low_high_ratio > 50
    top = spectral.peaks(spectra).first()
    assert top.peak_wavelength == pytest.approx(1 / 1.5, abs=0.05)
    power = spectral.spectrograms(rows, ["x"], window=2.0).groupBy("freq").avg("power").orderBy("avg(power)", ascending=False).first()
    assert power.freq == pytest.approx(1.5)
    low = spectral.low_pass(rows, "x", cutoff=1.0).toPandas()
    assert abs(low["value"] - 0.1 * low["depth"]).median() < 0.1
    whole = spectral.profile_power(rows, "x").orderBy("power", ascending=False).first()
    assert whole.freq == pytest.approx(1.5, abs=0.1)


@pytest.mark.parametrize("few", [0, 1, 40, 4096])
def test_percentiles_by_radix_selection(spark, few):
    rng = np.random.default_rng(11)
    n = 700
    a, b = rng.normal(0, 100, n), rng.integers(-3, 4, n).astype(float)
    c = np.where(rng.random(n) < 0.6, rng.normal(0, 1e-300, n), 1e300)
    rows = [(float(a[i]), float(b[i]) if i % 3 else None, float(c[i]), None, 7.0 if i == 5 else None, int(i * 10**15)) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, `b.x` double, c double, d double, e double, f long").repartition(3)
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = df.agg(*[F.percentile(f"`{x}`", F.array(*map(F.lit, at))).alias(x) for x in df.columns]).first().asDict()
    assert selection.percentiles(df, df.columns, at, few) == {x: v and list(v) for x, v in want.items()}
    assert selection.percentiles(df.limit(0), ["a"], at, few) == {"a": None} and selection.percentiles(df, [], at) == {}


def test_ordered_bits_order_as_values():
    x = np.array([-np.inf, -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.5, 1e300, np.inf, np.nan])
    bits = selection.ordered_bits(x)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[4] == bits[5]
    assert [selection.value_of(int(v)) for v in bits[:10]] == x[:10].tolist()


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_mixtures_of_all_numbers_share_their_scans(spark, monkeypatch, kind):
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(m, 0.5, (60, 2)) for m in ((0, 0), (4, 0), (0, 5))])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    scans = []
    plain = model._pass
    monkeypatch.setattr(model, "_pass", lambda *a: scans.append(len(a[2])) or plain(*a))
    together = model.mixtures(df, [1, 2, 3, 4], kind, seed=1)
    shared, alone = len(scans), []
    for k in (1, 2, 3, 4):
        scans.clear()
        one = model.mixture(df, k, kind, seed=1)
        alone.append(len(scans))
        assert abs(one.bic - together[k].bic) < 1e-6 and np.allclose(one.covariances, together[k].covariances)
    assert shared == max(alone)
    fit = together[3]
    r = np.exp(fit.log_parts(x) - np.logaddexp.reduce(fit.log_parts(x), axis=1)[:, None])
    assert abs(np.logaddexp.reduce(fit.log_parts(x), axis=1).sum() - fit.log_likelihood) < 1e-6 and r.sum(axis=1).round(9).tolist() == [1.0] * len(x)
    assert min(together, key=lambda k: together[k].bic) == 3


def test_spectra_of_segments_transformed_together(spark):
    rng = np.random.default_rng(18)
    rows, want = [], {}
    for target in ("a", "b"):
        for segment in range(70):
            depth = np.sort(rng.uniform(0, rng.choice([0.05, 0.5, 0.5, 1.3]), rng.integers(1, 40)))
            for s, values in (("x", rng.normal(0, 1, len(depth))), ("y", np.where(rng.random(len(depth)) < 0.2, np.nan, depth))):
                if (found := spectral.spectrum(depth, values, 0.02)) is not None:
                    want |= {(target, segment, s, round(float(f), 9)): float(a) for f, a in zip(*found, strict=True)}
                rows += [(target, segment, s, float(d), None if np.isnan(v) else float(v)) for d, v in zip(depth, values, strict=True)]
    df = spark.createDataFrame(rows, "target string, segment_id int, s string, depth double, v double")
    wide = df.groupBy("target", "segment_id", "depth").pivot("s", ["x", "y"]).agg(F.first("v"))
    got = {(r.target, r.segment_id, r.sensor, round(r.freq, 9)): r.amp for r in spectral.segment_spectra(wide, ["x", "y"]).collect()}
    assert got.keys() == want.keys() and len(got) > 500 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert spectral.segment_spectra(wide.limit(0), ["x"]).collect() == []
