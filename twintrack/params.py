"""Preprocessing parameters: defaults, overrides by nested dictionaries, range checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class Data:
    fps: float = 80.0
    pixel_size_mm: float = 1 / 1.97
    n_coords_expected: int = 2
    n_nodes_expected: int = 13


@dataclass(frozen=True)
class Confidence:
    enabled: bool = True
    require_scores: bool = False
    mode: str = "adaptive_per_node"
    threshold: float = 0.2
    threshold_by_node: tuple[float, ...] = ()
    prctile: float = 2.0
    min_threshold: float = 0.03
    max_mask_fraction: float = 0.50
    relaxed_threshold: float = 0.01


@dataclass(frozen=True)
class Jump:
    enabled: bool = True
    diff_quantile: float = 0.995
    max_iter: int = 20
    min_valid_points: int = 10
    method: str = "linear"
    dilate_frames: int = 1
    max_disp_mm_per_frame: float = 25.0
    #: From the default 25 mm and the default pixel size; it does not follow changes of either.
    max_disp_px_per_frame: float = 25.0 * 1.97
    max_disp_px_per_frame_by_node: tuple[float, ...] = ()


@dataclass(frozen=True)
class Gaps:
    enabled: bool = True
    method: str = "linear"
    max_gap_frames: int = 8
    fill_ends: bool = False
    min_points_for_interp: int = 2
    # nodes 1 to 13; paws 5 to 8 and the trunk 9, 10, 13 differ
    max_gap_frames_by_node: tuple[int, ...] = (8, 8, 8, 8, 5, 5, 5, 5, 15, 15, 8, 8, 15)


@dataclass(frozen=True)
class Smooth:
    enabled: bool = True
    method: str = "lowpass"
    low_pass_frq: float = 8.0
    n_pad: int = 20
    min_segment_length: int = 45
    low_pass_frq_by_node: tuple[float, ...] = (8, 8, 8, 8, 10, 10, 10, 10, 6, 6, 8, 8, 6)
    break_at_repaired_points: bool = True
    repair_break_halfwidth: int = 1


@dataclass(frozen=True)
class Qc:
    frame_bad_node_frac_thresh: float = 0.25
    max_interp_frac_per_frame: float = 0.35
    max_jump_frac_per_frame: float = 0.35
    max_geom_frac_per_frame: float = 0.35
    max_arena_frac_per_frame: float = 0.35
    max_lowconf_frac_per_frame: float = 0.50
    expand_severe_badframes: int = 0
    body_length_nodes: tuple[int, int] = (1, 10)
    body_length_prctile_range: tuple[float, float] = (1.0, 99.0)
    require_finite_body_length: bool = True
    geometry_node_pairs: tuple[tuple[int, int], ...] = ((1, 10), (2, 10), (5, 10), (6, 10), (7, 10), (8, 10))
    geometry_prctile_range: tuple[float, float] = (1.0, 99.0)
    arena_anchor_node: int = 10
    arena_percentile: tuple[float, float] = (1.0, 99.0)
    arena_margin_px: float = 40.0


@dataclass(frozen=True)
class Output:
    return_raw: bool = True
    audit_plot_dpi: int = 220


INTERPOLATION = ("linear", "nearest", "pchip", "makima", "spline")
#: Accepted for compatibility; nothing reads them.
IGNORED = {
    "data": ("noi", "n_animals_expected"),
    "confidence": ("adaptive_per_node", "prctile_method"),
    "jump": ("use_excludedFrames_mask", "interpolate_method", "max_disp_mm_per_frame_by_node"),
    "qc": ("enabled", "geometry_use_confidence_for_blame"),
    "output": ("keep_original_nan_mask", "store_full_masks", "make_plots"),
    "meta": ("version", "created_by", "description"),
    "debug": ("enabled", "store_intermediate", "verbose"),
}


def _whole(least: int):
    return lambda v: v >= least and float(v).is_integer()


_share = lambda v: 0 <= v <= 1
_positive = lambda v: 0 < v < float("inf")
_each = lambda rule: lambda vs: all(rule(v) for v in vs)
_range = lambda v: len(v) == 2 and v[0] < v[1]

#: What each parameter must fulfil, by section.
RULES = {
    "data": {"fps": _positive, "pixel_size_mm": _positive, "n_coords_expected": lambda v: v == 2},
    "confidence": {
        "mode": lambda v: str(v).lower() in ("fixed", "fixed_by_node", "adaptive_per_node"),
        "threshold": _share,
        "threshold_by_node": _each(_share),
        "prctile": lambda v: 0 <= v <= 100,
        "min_threshold": _share,
        "max_mask_fraction": _share,
        "relaxed_threshold": _share,
    },
    "jump": {
        "diff_quantile": lambda v: 0 < v < 1,
        "max_iter": _whole(1),
        "min_valid_points": lambda v: v >= 2,
        "max_disp_mm_per_frame": _positive,
        "max_disp_px_per_frame": _positive,
        "dilate_frames": _whole(0),
        "method": lambda v: str(v).lower() in INTERPOLATION,
        "max_disp_px_per_frame_by_node": _each(_positive),
    },
    "gaps": {
        "max_gap_frames": _whole(0),
        "min_points_for_interp": _whole(2),
        "max_gap_frames_by_node": _each(_whole(0)),
        "method": lambda v: str(v).lower() in INTERPOLATION,
    },
    "smooth": {
        "method": lambda v: str(v).lower() in ("lowpass", "none"),
        "low_pass_frq": _positive,
        "n_pad": _whole(0),
        "min_segment_length": _whole(1),
        "repair_break_halfwidth": _whole(0),
        "low_pass_frq_by_node": _each(_positive),
    },
    "qc": {
        **{f.name: _share for f in fields(Qc) if f.name.endswith(("_thresh", "_per_frame"))},
        "expand_severe_badframes": _whole(0),
        "body_length_nodes": lambda v: len(v) == 2,
        "geometry_node_pairs": _each(lambda p: len(p) == 2),
        "body_length_prctile_range": _range,
        "geometry_prctile_range": _range,
        "arena_percentile": _range,
        "arena_anchor_node": _whole(1),
        "arena_margin_px": lambda v: v >= 0,
    },
    "output": {"audit_plot_dpi": lambda v: v > 0},
}


@dataclass(frozen=True)
class Params:
    data: Data = field(default_factory=Data)
    confidence: Confidence = field(default_factory=Confidence)
    jump: Jump = field(default_factory=Jump)
    gaps: Gaps = field(default_factory=Gaps)
    smooth: Smooth = field(default_factory=Smooth)
    qc: Qc = field(default_factory=Qc)
    output: Output = field(default_factory=Output)

    def __post_init__(self):
        for section, rules in RULES.items():
            for name, rule in rules.items():
                value = getattr(getattr(self, section), name)
                if not rule(value):
                    raise ValueError(f"parameter {section}.{name} is out of range: {value!r}")
        if self.confidence.mode.lower() == "fixed_by_node" and not self.confidence.threshold_by_node:
            raise ValueError("confidence.threshold_by_node is required for the mode fixed_by_node")

    @classmethod
    def of(cls, overrides: dict | None = None) -> Params:
        """Defaults with a nested dictionary laid over them; user values win."""
        return _merged(cls(), merge({}, overrides or {}))

    def as_dict(self) -> dict:
        return asdict(self)


def merge(base: dict, over: dict) -> dict:
    """Nested dictionaries laid over each other: values of ``over`` win, keys of either stay."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def _merged(node, over: dict, section: str = ""):
    known, changes = {f.name: getattr(node, f.name) for f in fields(node)}, {}
    for key, value in over.items():
        if key in known:
            if is_dataclass(known[key]):
                changes[key] = _merged(known[key], value, key)
            else:
                changes[key] = tuple(value) if isinstance(value, list) else value
        elif key not in IGNORED.get(section, ()) and not (section == "" and key in IGNORED):
            raise ValueError(f"unknown parameter {section}.{key}")
    return replace(node, **changes)


def by_node(values: tuple, default, node):
    """Column: the entry of ``values`` for a 1-based node column, the default beyond its end."""
    from pyspark.sql import functions as F

    if not values:
        return F.lit(default)
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in values]), node - 1), F.lit(default))
