"""Settings of the detectors, as plain records whose fields become literals in the plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SpatialSettings:
    """The spatial detector: tiles of pixel changes between neighbouring frames, and the choice of representatives."""

    pixel_delta: int = 20
    edge_delta: int = 25
    tile: int = 20
    cell_changed_fraction: float = 0.02
    changed_fraction: float = 0.06
    cell_fraction: float = 0.30
    support_samples: int = 2
    core_edge_fraction: float = 0.6
    overlay_fraction: float = 0.25
    overlay_missing_edges: int = 8
    transient_penalty: float = 0.25


@dataclass(frozen=True)
class AnchorSettings:
    """The anchor detector: mean absolute differences, whole and by overlapping tiles."""

    mad: float = 0.005
    tile_mad: float = 0.025
    pixel_delta: int = 20
    changed_fraction: float = 0.0002
    tile: int = 20
    stride: int = 10
    keep_unconfirmed: bool = True
    debounce_samples: int = 2


BLACK_LEVEL = 8
MAX_CACHE_WIDTH = 640
MAX_DETECTOR_WIDTH = 320
