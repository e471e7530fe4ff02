"""Parameters of an analysis and the per-style bundles that may override them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class StyleProfile:
    """What a picture style sets: models, identity threshold, crop margin, least face height, frontal weight."""

    detector: str
    embedder: str
    identity_threshold: float
    crop_margin: float
    min_face_height_ratio: float
    frontal_weight: float = 0.0


#: Fixed values of the three styles.
PROFILES = {
    "2d": StyleProfile("anime_face_imgutils", "ccip", 0.20, 0.6, 0.03),
    "3d": StyleProfile("real_face_scrfd", "arcface", 0.85, 0.0, 0.045),
    "real": StyleProfile("real_face_scrfd", "arcface", 0.85, 0.0, 0.09),
}
#: Thresholds of embedders that are used where none is set.
EMBEDDER_THRESHOLDS = {"ccip": 0.178, "arcface": 0.6}


@dataclass(frozen=True)
class Config:
    """Defaults of an analysis; times are seconds."""

    frame_interval: float = 0.3
    cut_time_tolerance: float = 0.1
    clip_snap_max_shift: float = 2.0
    detector: str = "anime_face_imgutils"
    conf_threshold: float = 0.5
    min_face_height_ratio: float = 0.045
    blur_var_threshold: float = 50.0
    crop_margin: float = 0.0
    require_eyes: int = 0
    frontal_weight: float = 0.0
    min_frontal_score: float = 0.0
    iou_threshold: float = 0.3
    track_gap_tolerance: int = 1
    crops_per_track: int = 1
    min_track_seconds: float = 0.0
    crop_min_gap_frames: int = 0
    style_routing: bool = True
    force_style: str | None = None
    style_probe_frames: int = 16
    style_real_evidence_ratio: float = 0.5
    style_ambiguous_band: tuple[float, float] = (0.45, 0.80)
    embedder: str = "ccip"
    identity_threshold: float | None = 0.178
    cluster_scope: str = "window"
    min_character_seconds: float = 0.0
    window_seconds: float = 30.0
    min_events_per_window: int = 4
    strict_non_overlap: bool = False
    style_profiles: dict[str, StyleProfile] = field(default_factory=lambda: dict(PROFILES))

    def with_style(self, style: str | None) -> Config:
        """The config under a style; an unknown one changes nothing, a known one overrides what it sets."""
        profile = self.style_profiles.get(style or "")
        if profile is None:
            return self
        names = ("detector", "embedder", "identity_threshold", "crop_margin", "min_face_height_ratio", "frontal_weight")
        return replace(self, **{n: getattr(profile, n) for n in names})

    def with_frontal_weight(self, weight: float) -> Config:
        """Set the weight here and in every profile, since a profile would otherwise win."""
        profiles = {k: replace(p, frontal_weight=weight) for k, p in self.style_profiles.items()}
        return replace(self, frontal_weight=weight, style_profiles=profiles)

    def threshold(self) -> float:
        """The identity threshold: the one set, or the embedder's own."""
        return self.identity_threshold if self.identity_threshold is not None else EMBEDDER_THRESHOLDS[self.embedder]
