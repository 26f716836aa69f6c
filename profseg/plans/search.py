"""Searches over detection settings: grids, ablations and sweeps of refinements."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import clean, detect, evaluate, hazards, refine
from ..sources.shared import settled
from .config import Detection
from .pipelines import detect_profiles


@dataclass(frozen=True)
class Axes:
    """What a grid varies: pairs of (least soft, least hard) thickness, (smoothing, its largest weight), whether flat points are
    dropped by signal-to-noise ratio, radius of refinement, base hazard, automatic contrast."""

    thickness: list[tuple[float, float]]
    smoothing: list[tuple[str | None, float]]
    drop: list[bool]
    radius: list[float]
    base: list[str]
    contrast: list[bool]

    def combinations(self) -> list[dict]:
        rows = product(self.thickness, self.smoothing, self.drop, self.radius, self.base, self.contrast)
        return [{"soft": t[0], "hard": t[1], "smooth": s[0], "weight": s[1], "drop": d, "radius": r, "base": b, "contrast": c} for t, s, d, r, b, c in rows]


#: Axes of the three grids, in depth units.
_PAIRS = [(0.50, 0.50), (1.00, 0.50), (1.00, 1.00), (1.50, 0.50), (1.50, 1.50)]
_MORE_PAIRS = [*_PAIRS, (0.75, 0.75), (1.25, 1.25), (2.00, 2.00)]
_SMOOTHING = [(None, 0.30), ("tv", 0.30), ("savgol", 0.30)]
_MORE_SMOOTHING = [(None, 0.30), ("tv", 0.15), ("tv", 0.30), ("tv", 0.50), ("savgol", 0.30)]
GRIDS = {
    "quick": Axes(_PAIRS, _SMOOTHING, [True, False], [0.5], ["const"], [False]),
    "standard": Axes(_MORE_PAIRS, _MORE_SMOOTHING, [True, False], [0.3, 0.5, 0.7], ["const"], [False]),
    "extended": Axes(_MORE_PAIRS, _MORE_SMOOTHING, [True, False], [0.3, 0.5, 0.7], ["const", "depth"], [False, True]),
}
#: Base and largest thickness of the adaptive prior, growth with depth, contrast window, and the tolerances.
BASE_THICKNESS, MOST_THICKNESS, GROWTH, CONTRAST_WINDOW = 1.0, 30.0, 0.05, 0.5
TOLERANCES = (0.5, 1.0, 2.0)
#: Settings that one task runs over a profile.
CHUNK = 8


def _inputs(df: DataFrame, x: str, axes: Axes, step: float, unit: float) -> DataFrame:
    """Samples with what the settings share: contrast, its strength, and the thickness prior for each soft floor."""
    rows = clean.spread(df.select("target", F.col("depth").cast("double").alias("depth"), F.col(x).cast("double").alias("x")), "target")
    parts = hazards.kappa_inputs(rows, "x")
    pairs = sorted(set(axes.thickness))
    thick = [hazards.blended(max(s, h) * unit, BASE_THICKNESS * unit, s * unit, max(MOST_THICKNESS, 4 * s) * unit)["thickness"] for s, h in pairs]
    own = parts.select("target", "iqr", "step", F.array(*thick).alias("thick"))
    noise = hazards.local_noise(rows, "x", max(2, round(0.15 * unit / step)))
    auto = hazards.contrast_parameters(F.col("iqr"), F.col("local_noise"))
    own = own.join(noise, "target").select("target", "step", "thick", auto["contrast_strength"].alias("strength"), auto["drop_quantile"].alias("drop"))
    contrast = hazards.lr_contrast(rows, "x", max(1, round(CONTRAST_WINDOW * unit / step)))
    return contrast.join(own, "target")


def _factor(contrast: np.ndarray, strength: float) -> np.ndarray:
    """The factor of hazards.with_rate_factor() over one profile."""
    raw = np.clip(1 + strength * (contrast / max(float(contrast.mean()), 1e-12) - 1), 1e-3, 100)
    return raw / raw.mean() if raw.mean() > 0 else np.ones(len(raw))


def _detections(rows: DataFrame, settings: list[dict], pairs: list[tuple[float, float]], unit: float, prior: dict) -> DataFrame:
    """(setting, target, i): change points under every setting. A profile's samples go to a task once for CHUNK settings, which
    share its gaps' filling and its smoothing."""
    chunks = -(-len(settings) // CHUNK)
    dealt = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def chunk_of(tables: list[pa.Table], chunk: int) -> pa.RecordBatch:
        thick = [np.array(t.column("thick")[0].as_py(), float) for t in tables]
        profiles = [detect.Profile.of(t.select(["target", "depth", "x", "contrast", "step", "strength"])) for t in tables]
        steps, strengths = ([float(p.columns[c][0]) for p in profiles] for c in ("step", "strength"))
        signals = [detect.fill(p.columns["x"]) for p in profiles]
        centres = [float(np.median(x)) for x in signals]
        smoothed: dict[tuple, list[np.ndarray]] = {}
        numbers, targets, places = [], [], []
        for at in range(chunk * CHUNK, min(len(settings), (chunk + 1) * CHUNK)):
            s = settings[at]
            key = (s["smooth"], s["weight"])
            if key not in smoothed:
                smoothed[key] = [detect.adaptive_smooth(x, step, s["smooth"], s["weight"]) for x, step in zip(signals, steps, strict=True)] if s["smooth"] else signals
            priors = [float(t[pairs.index((s["soft"], s["hard"]))]) for t in thick]
            if s["base"] == "const":
                hazard = [np.full(len(p.depth), 1 / max(prior_thickness / step, 1.0)) for p, prior_thickness, step in zip(profiles, priors, steps, strict=True)]
            else:
                hazard = [np.clip(step / np.maximum(0.5 * unit, prior_thickness + GROWTH * p.depth), 1e-12, detect.LARGEST) for p, prior_thickness, step in zip(profiles, priors, steps, strict=True)]
            factors = [(_factor(p.columns["contrast"], strength),) if s["contrast"] and strength > 0 else () for p, strength in zip(profiles, strengths, strict=True)]
            runs = [round(s["hard"] * unit / step) for step in steps]
            for p, least, found in zip(profiles, runs, detect.detect_all(smoothed[key], centres, hazard, runs, factors, of_prior), strict=True):
                for i in detect.separated(found.boundaries.tolist(), max(1, least)):
                    numbers.append(at)
                    targets.append(p.target)
                    places.append(i)
        return pa.RecordBatch.from_pydict({"setting": pa.array(numbers, pa.int32()), "target": pa.array(targets, pa.string()), "i": pa.array(places, pa.int32())})

    of_prior = (prior.get("kappa", 1.0), prior.get("alpha", 1.0), prior.get("beta", 0.1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tables in detect.profile_batches(batches, ("chunk", "target")):
            for chunk, own in itertools.groupby(tables, lambda t: t.column("chunk")[0].as_py()):
                yield chunk_of(list(own), chunk)

    return clean.spread(dealt, "target", "chunk").sortWithinPartitions("chunk", "target").mapInArrow(run, "setting int, target string, i int")


def grid_search(df: DataFrame, sensor: str, truth: DataFrame, axes: Axes, step: float = 0.02, unit: float = 1.0, tolerances: tuple[float, ...] = TOLERANCES, **prior: float) -> DataFrame:
    """A row for each combination of a grid with its pooled and mean scores at three tolerances, rounded to four places, ranked by
    F1 at the middle, the narrow and the wide one; of equals the earlier combination. df: target, depth, sensor; truth: target,
    boundary. `unit` turns thicknesses, radii and tolerances into the depth unit of df, `step` is its usual step.

    Points are found once for each setting of the detection and refined under all of its combinations in one pass.
    """
    combos = axes.combinations()
    of_detection = ("soft", "hard", "smooth", "weight", "base", "contrast")
    settings = [dict(t) for t in dict.fromkeys(tuple((k, c[k]) for k in of_detection) for c in combos)]
    pairs = sorted(set(axes.thickness))
    named = df.withColumn("target", F.col("target").cast("string"))
    rows = settled(_inputs(named, sensor, axes, step, unit))
    raw = settled(_detections(rows, settings, pairs, unit, prior))
    samples = refine.with_gradient(rows.select("target", "depth", "x", "step"), "x", F.col("step"))
    samples = settled(samples.withColumn("i", F.col("i").cast("int")))
    own = rows.groupBy("target").agg(F.first("drop").alias("drop"))
    points = raw.join(own, "target")
    variants = [{"name": f"{d}/{r}", "radius": max(1, round(r * unit / step)), "drop": F.col("drop") if d else None, "separation": 0} for d, r in product(axes.drop, axes.radius)]
    moved = refine.snap_variants(points, samples, variants, ["setting"])
    gap = F.element_at(F.array(*[F.lit(max(1, round(s["hard"] * unit / step))) for s in settings]), F.col("setting") + 1)
    kept = moved.select("setting", "variant", "target", F.explode(refine.separate(F.col("indexes"), gap)).alias("i"))
    number = {(settings.index({k: c[k] for k in of_detection}), f"{c['drop']}/{c['radius']}"): n for n, c in enumerate(combos)}
    key = F.concat_ws("|", "setting", "variant")
    combo = F.element_at(F.create_map(*[F.lit(v) for (s, v_), n in number.items() for v in (f"{s}|{v_}", n)]), key)
    found = kept.select(combo.alias("combo"), "target", "i").join(samples.select("target", "i", F.col("depth").alias("boundary")), ["target", "i"])
    true = truth.select(F.col("target").cast("string").alias("target"), "boundary").join(own.select("target"), "target", "left_semi")
    scaled = tuple(t * unit for t in tolerances)
    scores = evaluate.pooled_by(evaluate.scores_by(found.select("combo", "target", "boundary"), "combo", list(range(len(combos))), true, scaled), "combo", scaled)
    values = F.array(*[F.struct(*[F.lit(v).cast("string" if k in ("smooth", "base") else "boolean" if k in ("drop", "contrast") else "double").alias(k) for k, v in c.items()]) for c in combos])
    out = scores.withColumn("settings", F.element_at(values, F.col("combo") + 1)).select("combo", "settings.*", *[F.round(c, 4).alias(c) for c in scores.columns if c.split("_")[0] in ("f1", "precision", "recall", "mean")])
    f1 = [F.desc(f"f1_{evaluate.name_of(scaled[i])}") for i in (1, 0, 2)]
    # a row a combination: one small window
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*f1, "combo")))


_PLAIN = Detection(mean_from_signal=False, contrast=False)
_K30, _DEPTH = replace(_PLAIN, expected_thickness=0.6), replace(_PLAIN, base="depth")
#: The experiments of the ablation, thicknesses in depth units (kappa of 30 samples on a 0.02 grid is 0.6).
ABLATION = {
    "baseline_paper": _PLAIN,
    "uni_Ic_k30_const": _K30,
    "uni_Ic_depth": _DEPTH,
    "uni_Ic_k30_minthick05": replace(_K30, least_thickness=0.5),
    "uni_Ic_depth_minthick05": replace(_DEPTH, least_thickness=0.5),
    "uni_Ic_k30_const_refine": replace(_K30, refine_radius=0.7),
    "uni_Ic_k30_minthick05_refine": replace(_K30, least_thickness=0.5, refine_radius=0.7),
    "uni_Ic_depth_minthick05_refine": replace(_DEPTH, least_thickness=0.5, refine_radius=0.7),
    "uni_Ic_k30_minthick05_refine_r03": replace(_K30, least_thickness=0.5, refine_radius=0.3),
}
#: The experiments on vectors, which cost more and are run where asked for.
MULTIVARIATE = {
    "mv_logQtn_logFr_const": replace(_PLAIN, features=("logQtn", "logFr")),
    "mv_logQtn_logFr_depth_minthick": replace(_DEPTH, features=("logQtn", "logFr"), least_thickness=0.5),
    "mv_logQtn_logFr_U2_depth_minthick": replace(_DEPTH, features=("logQtn", "logFr", "U2"), least_thickness=0.5),
}


def scaled(cfg: Detection, feature: str, unit: float, **more) -> Detection:
    """A setting in another depth unit, for another feature."""
    lengths = ("adaptive_base", "adaptive_least", "adaptive_most", "expected_thickness", "least_thickness", "contrast_window", "refine_radius", "least_separation", "bandwidth")
    return replace(cfg, feature=feature, **{k: v * unit for k in lengths if (v := getattr(cfg, k)) is not None}, **more)


def ablation(df: DataFrame, truth: DataFrame, experiments: dict[str, Detection], step: float = 0.02, places: DataFrame | None = None, tolerances: tuple[float, ...] = TOLERANCES, neighbours: int = 6, strength: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Every experiment, and the best of them by pooled F1 at the middle tolerance (the first of equals) once more with the density
    of its points in the targets around as a factor. Points (method, target, boundary) and a row of pooled scores a method."""
    named = lambda name, points: points.select(F.lit(name).alias("method"), F.col("target").cast("string").alias("target"), "boundary")
    true = truth.select(F.col("target").cast("string").alias("target"), "boundary")
    points = None
    for name, cfg in experiments.items():
        part = named(name, detect_profiles(df, cfg, step))
        points = part if points is None else points.unionByName(part)
    points = settled(points)
    score = lambda p, names: evaluate.pooled_by(evaluate.scores_by(p, "method", names, true, tolerances), "method", tolerances)
    table = settled(score(points, list(experiments)))
    if places is None:
        return points, table
    f1 = {r.method: r[f"f1_{evaluate.name_of(tolerances[1])}"] for r in table.collect()}
    best = max(experiments, key=lambda name: f1[name])
    again = replace(experiments[best], neighbours=neighbours, neighbour_strength=strength)
    predicted = points.filter(F.col("method") == best).select("target", "boundary")
    spatial = settled(named(f"{best}__spatial", detect_profiles(df, again, step, places, around=predicted)))
    return points.unionByName(spatial), table.unionByName(score(spatial, [f"{best}__spatial"]))


#: The refinements of the sweep, radii in depth units.
REFINEMENTS = [
    *[{"radius": r} for r in (0.3, 0.5, 0.7, 1.0)],
    *[{"radius": r, "nearest": True} for r in (0.3, 0.5, 0.7, 1.0, 1.5)],
    {"radius": 0.7, "nearest": True, "strength": 1.5},
    {"radius": 1.0, "nearest": True, "strength": 1.5},
    {"radius": 0.7, "strength": 2.0},
]
#: Least separation and samples of smoothing of refinements, the quantiles of change probabilities to keep from, smoothing
#: windows by radius, ratios of the two radii, and quantiles of peaks that are added.
SEPARATION, SMOOTH = 0.5, 5
QUANTILES = (0.0, 0.10, 0.20, 0.30, 0.50)
SMOOTHINGS = {0.3: (0, 5, 11, 21, 41, 81), 0.7: (5, 11, 21, 41, 81)}
TWO_RADII, RATIOS = (0.3, 0.7), (1.3, 1.5, 2.0, 3.0)
ADDED = (0.80, 0.85, 0.90, 0.95)


def refinement_name(v: dict) -> str:
    parts = [f"r{v['radius']:.1f}", "nearest_peak" if v.get("nearest") else "argmax"]
    return "_".join([*parts, *[f"{k}{v[key]}" for k, key in (("sr", "strength"), ("dq", "drop")) if v.get(key) is not None]])


def refine_sweep(df: DataFrame, truth: DataFrame, cfg: Detection, step: float = 0.02, unit: float = 1.0, refinements: list[dict] | None = None, tolerances: tuple[float, ...] = TOLERANCES) -> DataFrame:
    """A row of pooled scores for the raw points, each refinement of them, refinements of those that are likely enough, refinements
    of differently smoothed signals, the peaks of two radii, and the points with strong peaks added, refined. Points are found once and
    written; so are the gradients of each smoothing, and all refinements by one of these are one pass over the points."""
    raw = settled(detect_profiles(df, replace(cfg, refine_radius=0.0), step, with_probability=True))
    rows = df.select(F.col("target").cast("string").alias("target"), F.col("depth").cast("double").alias("depth"), F.col(cfg.feature).cast("double").alias("x"))
    stepped = settled(rows.hint("merge").join(clean.step_of(rows), "target"))
    windows = sorted({w for own in SMOOTHINGS.values() for w in own} | {SMOOTH})
    samples = {w: settled(refine.with_gradient(stepped, "x", F.col("step"), w).withColumn("i", F.col("i").cast("long"))) for w in windows}
    size = lambda length: max(1, round(length * unit / step))
    variant = lambda name, v: v | {"name": name, "radius": size(v["radius"]), "separation": size(SEPARATION)}
    chosen = refinements if refinements is not None else REFINEMENTS
    small = {"radius": TWO_RADII[0]}
    own = {SMOOTH: [variant(refinement_name(v), v) for v in chosen]}
    for radius, sizes in SMOOTHINGS.items():
        for w in sizes:
            own.setdefault(w, []).append(variant(f"r{radius}_argmax_sw{w}", {"radius": radius}))
    # each part is written by itself: one plan of them all, with its broadcasts, would be held by the driver at once
    moved = [settled(refine.snap_variants(raw, samples[w], vs).select("variant", "target", F.explode("indexes").alias("i"))) for w, vs in own.items()]
    # other sets of points, all under the small radius
    points = raw.select("target", "i", "p_change")
    sets = [(f"r0.3_argmax_conf_q{q:.2f}", refine.confident(points, "p_change", q).select("target", "i")) for q in QUANTILES]
    sets += [(f"aug_topg{q:.2f}_r0.3_argmax", refine.augment(points, samples[SMOOTH], q, size(SEPARATION))) for q in ADDED]
    others = None
    for name, some in sets:
        part = some.select(F.lit(name).alias("set"), "target", F.col("i").cast("long").alias("i"))
        others = part if others is None else others.unionByName(part)
    moved.append(settled(refine.snap_variants(settled(others), samples[SMOOTH], [variant("", small)], ["set"]).select(F.col("set").alias("variant"), "target", F.explode("indexes").alias("i"))))
    for ratio in RATIOS:
        far = refine.two_radii(points, samples[SMOOTH], size(TWO_RADII[0]), size(TWO_RADII[1]), ratio)
        kept = far.groupBy("target").agg(refine.separate(F.array_sort(F.collect_set("j")), size(SEPARATION)).alias("indexes"))
        moved.append(settled(kept.select(F.lit(f"hybrid_r03_r07_ratio{ratio}").alias("variant"), "target", F.explode("indexes").alias("i"))))
    found = moved[0]
    for more in moved[1:]:
        found = found.unionByName(more)
    # many rows in few bytes of Parquet: they would be broadcast
    placed = found.hint("merge").join(samples[SMOOTH].select("target", "i", F.col("depth").alias("boundary")), ["target", "i"])
    parts = settled(raw.select(F.lit("base_no_refine").alias("variant"), "target", "boundary").unionByName(placed.select("variant", "target", "boundary")))
    names = ["base_no_refine", *[v["name"] for vs in own.values() for v in vs], *[name for name, _ in sets], *[f"hybrid_r03_r07_ratio{r}" for r in RATIOS]]
    true = truth.select(F.col("target").cast("string").alias("target"), "boundary")
    return evaluate.pooled_by(evaluate.scores_by(parts, "variant", names, true, tolerances), "variant", tolerances)


def top(table: DataFrame, n: int = 10, by: Column | None = None) -> DataFrame:
    """The first rows of a ranked table."""
    return table.orderBy(by if by is not None else F.col("rank")).limit(n)
