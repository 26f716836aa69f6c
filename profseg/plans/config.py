"""Settings of detection and clustering runs."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Detection:
    """A change-point run. Thicknesses and radii are in depth units."""

    feature: str = "Ic"
    kappa: float = 1.0
    alpha: float = 1.0
    beta: float = 0.1
    mean_from_signal: bool = True
    features: tuple[str, ...] = ()  # several: standardised vectors instead of the feature
    base: str = "const"  # or depth
    expected_thickness: float | None = None  # None: the number of samples
    adaptive_thickness: bool = False
    adaptive_base: float = 0.6
    adaptive_least: float = 0.5
    adaptive_most: float = 2.5
    adaptive_smooth: int = 11  # samples
    least_thickness: float = 0.0
    smooth: str | None = None
    contrast: bool | None = None  # None: by signal-to-noise ratio
    contrast_strength: float = 1.0
    contrast_window: float = 0.5
    refine_radius: float = 0.0
    refine_nearest: bool = False
    refine_ratio: float | None = None
    refine_smooth: int = 5  # samples
    drop_quantile: float | None = None
    auto_drop: bool = False  # the drop quantile follows the signal-to-noise ratio
    least_separation: float = 0.0
    neighbours: int = 0
    neighbour_strength: float = 1.0
    bandwidth: float = 1.5
    least_share: float = 0.0  # runs below this share of the posterior are dropped


#: The settings of the two standard runs, thicknesses in depth units.
BASELINE = Detection(mean_from_signal=False, contrast=False)
CANDIDATE = Detection(mean_from_signal=False, adaptive_thickness=True, adaptive_base=1.0, adaptive_least=0.75, adaptive_most=30.0, adaptive_smooth=0, least_thickness=0.75, smooth="savgol", refine_radius=0.3, refine_smooth=0, auto_drop=True)


#: The words of definitions.
SOURCES = ("ground_truth", "bocpd_estimate", "perfect_recall")
ALGORITHMS = ("gmm", "kmeans", "agglomerative")
REPRESENTATIONS = ("summary", "resample", "paa", "hybrid", "fft", "stft")


@dataclass(frozen=True)
class Clustering:
    """A clustering run."""

    model_id: str = ""
    sensors: tuple[str, ...] = ()
    representation: str = "summary"  # resample, paa, hybrid, fft, stft
    length: int = 32
    derivatives: bool = False
    stats: tuple[str, ...] = ("mean", "std", "median", "min", "max")
    thickness: bool = True
    algorithm: str = "gmm"  # kmeans, agglomerative
    selection: str = "bic"  # or fixed
    clusters: tuple[int, int] = (2, 10)
    covariance: str = "diag"
    components: int | None = None
    ridge: float = 1e-6
    seed: int = 0
    source: str = "ground_truth"  # bocpd_estimate, perfect_recall
    least_thickness: float = 0.0
    smoothing: float | None = None  # strength of the smoothing between locations
    radius: float = 0.0
    sigma: float = 1.0
    derived: tuple[str, ...] = ()  # Rf, log_qc
    columns: tuple[str, str, str, str] = ("SCPT_RES", "SCPT_FRES", "SCPT_NQT", "SCPT_NFR")  # cone, sleeve, normalised pair
    spectral: dict = field(default_factory=dict)  # settings of the spectral representations
    extra: dict = field(default_factory=dict)

    def check(self) -> Clustering:
        """This, if its words are known."""
        for name, value, known in (("boundary_source", self.source, SOURCES), ("model_type", self.algorithm, ALGORITHMS), ("representation", self.representation, REPRESENTATIONS)):
            if value not in known:
                raise ValueError(f"unknown {name}: {value}; there are: {', '.join(known)}")
        return self

    @classmethod
    def of(cls, model: dict, feature_set: dict) -> Clustering:
        """From a model definition and its feature set."""
        p, shape, spatial = model.get("parameters", {}), feature_set.get("representation") or {}, model.get("spatial_parameters", {})
        fixed = p.get("cluster_selection") == "fixed" or "n_clusters" in p and "max_clusters" not in p
        return cls(
            model_id=model["model_id"],
            sensors=tuple(c["name"] for c in feature_set.get("columns", [])),
            representation=shape.get("type", "summary"),
            length=int(shape.get("length", shape.get("bins", 32))),
            derivatives=bool(shape.get("include_derivatives", False)),
            stats=tuple(feature_set.get("segment_stats", cls.stats)),
            thickness=bool(feature_set.get("include_thickness", True)),
            algorithm=model.get("model_type", "gmm"),
            selection="fixed" if fixed else "bic",
            clusters=(int(p["n_clusters"]),) * 2 if fixed else (int(p.get("min_clusters", 2)), int(p.get("max_clusters", 10))),
            covariance=p.get("covariance_type", "full"),
            components=p.get("pca_n_components"),
            ridge=float(p.get("reg_covar", 1e-6)),
            seed=int(p.get("random_state", 0)),
            source=model.get("boundary_source", "ground_truth"),
            least_thickness=float(model.get("min_segment_thickness_m", 0.0)),
            smoothing=float(spatial.get("lambda", 1.0)) if model.get("use_spatial_mrf") else None,
            radius=float(spatial.get("max_distance_m", 0.0)),
            sigma=float(spatial.get("sigma_m", 1.0)),
            derived=tuple(feature_set.get("extra_derived") or ()),
            spectral={k: v for k, v in shape.items() if k.endswith(("_m", "_per_m"))},
            extra={k: v for k, v in model.items() if k not in {f.name for f in fields(cls)}},
        )


def summary_of(feature_set: dict) -> dict:
    """What a list of feature sets shows of one: representation, its size, statistics and number of columns, and labels."""
    shape = feature_set.get("representation") or {}
    kind, length, bins = shape.get("type", "summary"), shape.get("length"), shape.get("bins")
    stats = list(feature_set.get("segment_stats", []))
    low, high, bands = shape.get("min_frequency_cycles_per_m", 0.25), shape.get("max_frequency_cycles_per_m", 8.0), shape.get("bands_cycles_per_m", [])
    size, setting = {
        "summary": ("-", f"stats: {', '.join(stats) or '-'}"),
        "resample": (length or "-", f"length={length or '-'}"),
        "fft": (len(bands) if isinstance(bands, list) else "-", f"{low}-{high} cyc/m"),
        "row_local": ("-", "row-level local features"),
    }.get(kind, (bins or "-", f"bins={bins or '-'}"))
    label = kind if kind in ("summary", "row_local") else f"{kind if kind in ('resample', 'fft') else 'paa'} ({setting})"
    return {"representation_type": kind, "representation_length": length, "representation_bins": bins, "include_derivatives": bool(shape.get("include_derivatives", False)), "segment_stats": stats, "selected_columns_count": len(feature_set.get("columns", [])), "representation_size_label": str(size), "representation_config_label": setting, "comparison_representation_label": label}
