"""Configuration: defaults, overlays, camera profiles and checks, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np

from velograph.functions.geometry import fit_homography


def merged(*layers: dict[str, Any]) -> dict[str, Any]:
    """Later layers win; mappings are merged, everything else is replaced."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def check(config: dict[str, Any]) -> dict[str, Any]:
    faint = config.get("detector", {}).get("confidence")
    sure = config.get("tracker", {}).get("high_conf_det_threshold")
    if faint is not None and sure is not None and faint >= sure:
        raise ValueError("detector.confidence must be under tracker.high_conf_det_threshold")
    return config


def clean_camera_id(name: str) -> str:
    name = re.sub(r"\.mp4$", "", name.strip(), flags=re.IGNORECASE)
    if name in ("", ".", "..") or re.search(r"[\\/]", name):
        raise ValueError(f"not a camera id: {name!r}")
    return name


@dataclass(frozen=True)
class Camera:
    camera_id: str
    polygon: tuple[tuple[float, float], ...]
    line: tuple[tuple[float, float], tuple[float, float]] | None = None
    direction: str = "BOTH"
    homography: np.ndarray | None = None

    @classmethod
    def of(cls, d: dict[str, Any]) -> Camera:
        polygon = tuple(tuple(map(float, p)) for p in d["polygon"])
        if len(polygon) < 3:
            raise ValueError("a polygon has three points or more")
        line, plane = d.get("count_line"), d.get("homography")
        direction = (line or {}).get("direction", "BOTH")
        if direction not in ("A_TO_B", "B_TO_A", "BOTH"):
            raise ValueError(f"unknown direction {direction}")
        ends = (tuple(map(float, line["start"])), tuple(map(float, line["end"]))) if line else None
        return cls(clean_camera_id(d["camera_id"]), polygon, ends, direction, fit_homography(plane["source_points"], plane["target_points"]) if plane else None)


def plane_of(camera: Camera, enabled: bool = True) -> np.ndarray | None:
    """The camera's homography for the gates that a setting can turn off; linking takes ``camera.homography`` whatever it says."""
    return camera.homography if enabled else None


def read_yaml(path: str) -> dict[str, Any]:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def load_camera(folder: str, camera_id: str) -> Camera:
    return Camera.of(read_yaml(f"{folder}/{clean_camera_id(camera_id)}.yaml") | {"camera_id": camera_id})
