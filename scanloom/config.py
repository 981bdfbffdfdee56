"""Parameters of the engine, as presets of known sensors or from a YAML file."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from .functions.labels import VEHICLES, learning_map


@dataclass(frozen=True)
class Config:
    file_name_length: int = 6
    delta_elevation: float = 2.0
    delta_range: float = 1.0
    delta_azimuth: float = 2.0
    edge_limit: float = 60.0
    edge_bin: float = 2.0
    spectral_size: int = 30
    box_limit: float = 2.0
    triangle_limit: float = 20.0
    triangles_needed: int = 2
    graph_threshold: float = 0.5
    grid_threshold: float = 0.5
    grid_threshold_without_nodes: float = 0.7
    inlier_limit: float = 0.2
    gate: float = 0.15
    remap: bool = True
    label_map: dict[int, int] = field(default_factory=learning_map, hash=False)

    @property
    def deltas(self) -> tuple[float, float, float]:
        return self.delta_elevation, self.delta_range, self.delta_azimuth

    @property
    def edge_bins(self) -> int:
        return int(self.edge_limit / self.edge_bin)


KITTI = Config()
KITTI360 = Config(file_name_length=10, inlier_limit=0.5)
FORD = Config(delta_range=0.5, grid_threshold=0.45, gate=2.0, label_map=learning_map(ignore=VEHICLES))
APOLLO = Config()

# Keys of the YAML files.
YAML_KEYS = {
    "file_name_length": "file_name_length",
    "remap": "remap",
    "deltaA": "delta_elevation",
    "deltaR": "delta_range",
    "deltaP": "delta_azimuth",
    "edge_th": "edge_limit",
    "edge_sub_interval": "edge_bin",
    "graph_node_dimension": "spectral_size",
    "box_diff_th": "box_limit",
    "edge_local_triangle": "triangle_limit",
    "true_node_corres_th": "triangles_needed",
    "graph_sim_th": "graph_threshold",
    "back_sim_th": "grid_threshold",
    "back_sim_th_without_node": "grid_threshold_without_nodes",
    "inlier_th": "inlier_limit",
    "learning_map": "label_map",
}


def load(path: str, base: Config = KITTI) -> Config:
    """base with what a YAML file sets; other keys are ignored."""
    import yaml

    with open(path) as file:
        found = yaml.safe_load(file) or {}
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    values = {name: found[key] for key, name in YAML_KEYS.items() if key in found}
    return replace(base, **{k: kinds[k](v) for k, v in values.items()})
