"""Options of a warp, checked once; a plan never changes them afterwards."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class WarpOptions:
    grid_file: str | None = None
    file_type: str = "cgns"
    specified_surfaces: tuple[str, ...] | None = None
    symmetry_surfaces: tuple[str, ...] | None = None
    symmetry_planes: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...] | None = None
    a_exp: float = 3.0
    b_exp: float = 5.0
    ldef_fact: float = 1.0
    alpha: float = 0.25
    err_tol: float = 5e-4
    eval_mode: str = "fast"
    symm_tol: float = 1e-6  # kept for callers; no operator reads it
    use_rotations: bool = True
    zero_corner_rotations: bool = True
    corner_angle: float = 30.0
    restart_file: str | None = None
    bucket_size: int = 8

    def __post_init__(self):
        for name, choices in (("file_type", ("cgns", "openfoam", "plot3d")), ("eval_mode", ("fast", "exact"))):
            value = str(getattr(self, name)).strip().lower()
            if value not in choices:
                raise ValueError(f"{name} is one of {choices}, not {getattr(self, name)!r}")
            object.__setattr__(self, name, value)
        for name in ("a_exp", "b_exp", "ldef_fact", "alpha", "err_tol"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        if self.bucket_size < 1:
            raise ValueError("bucket_size must be at least 1")
        if not 0 <= self.corner_angle <= 180:
            raise ValueError("corner_angle is in degrees, from 0 to 180")

    @classmethod
    def of(cls, options: dict | None) -> WarpOptions:
        """From a mapping whose keys may be written in any case and with or without underscores."""
        known = {f.name.replace("_", ""): f.name for f in fields(cls)}
        out = {}
        for key, value in (options or {}).items():
            name = known.get(key.replace("_", "").lower())
            if name is None:
                raise ValueError(f"unknown option {key!r}")
            if name in ("specified_surfaces", "symmetry_surfaces") and value is not None:
                value = tuple(value)
            if name == "symmetry_planes" and value is not None:
                value = tuple((tuple(map(float, p)), tuple(map(float, n))) for p, n in value)
            out[name] = value
        return cls(**out)
