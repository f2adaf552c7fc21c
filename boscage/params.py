"""Parameters of all operators as frozen dataclasses."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace

#: The domain of UserData.
TREE, LOW, UNDERSTORY, BUFFER = 0, 1, 2, 3


@dataclass(frozen=True)
class PathFinder:
    downward: bool = False
    k_neighborhood_connectivity: int = 10
    k_seed_connectivity: int = 100
    decimation: float = 0.05
    space_res: float = 0.2
    max_gap: float = 1.0
    distance_power: float = 3.0
    penalty: tuple[float, ...] = tuple(math.exp(0.046051 * d) if d <= 100 else 100.0 for d in range(181))

    def __post_init__(self):
        if len(self.penalty) != 181:
            raise ValueError("path_finder.penalty needs 181 entries")


@dataclass(frozen=True)
class Instance:
    wood2wood: float = 0.1
    leaf2leaf: float = 20.0
    wood2leaf: float = 1000.0


@dataclass(frozen=True)
class Semantic:
    min_passage: int = 3
    high_pwood: float = 0.9
    medium_pwood: float = 0.75
    cc_res: float = 0.05
    cc_min: int = 2000
    wood_assignation_k: int = 50
    wood_assignation_dist: float = 0.05
    wood_extra_k: int = 10
    wood_extra_dist: float = 0.03
    sor_k: int = 50
    sor_m: float = 0.05
    ground_res: float = 0.2


@dataclass(frozen=True)
class Seed:
    slice_at: tuple[float, ...] = (0.7, 0.9)
    slice_thickness: float = 0.05
    min_passage: int = 15
    safe_zone: float = 0.2


@dataclass(frozen=True)
class Qsm:
    skeleton_node_distance: float = 0.1
    dbscan_eps: float = 0.1
    max_d: float = 0.1
    apex_radius: float = 0.0025
    smooth_steps: int = 15
    min_measurable_dbh: float = 0.05
    min_measurable_radius: float = 0.025
    broken_detection: bool = True
    allometry_scale: float = 1.0
    allometry_name: str = "Griese2025"


@dataclass(frozen=True)
class Params:
    cut_above_ground: float = 0.25
    woodlikelihood_k: int = 80
    path_finder: PathFinder = field(default_factory=PathFinder)
    instance: Instance = field(default_factory=Instance)
    semantic: Semantic = field(default_factory=Semantic)
    seed: Seed = field(default_factory=Seed)
    qsm: Qsm = field(default_factory=Qsm)

    @classmethod
    def of(cls, values: dict) -> Params:
        """Parameters from nested dicts; an unknown or missing group or name is an error."""
        out = cls()
        for group in fields(cls):
            if group.name not in values:
                raise KeyError(f"missing parameter {group.name}")
            own = values[group.name]
            if isinstance(own, dict):
                now = getattr(out, group.name)
                names = {f.name for f in fields(now)}
                if set(own) != names:
                    raise KeyError(f"{group.name}: {sorted(set(own) ^ names)} missing or unknown")
                own = type(now)(**own)
            out = replace(out, **{group.name: own})
        return out
