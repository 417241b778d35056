"""Typed graphs: node types, edge types, and their configuration."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class NodeType:
    name: str
    table: str
    id_column: str


@dataclass(frozen=True)
class EdgeType:
    name: str
    table: str
    u_type: str
    u_column: str
    v_type: str
    v_column: str


@dataclass(frozen=True)
class GraphSchema:
    """A type's index is its place in the configuration."""

    nodes: tuple[NodeType, ...]
    edges: tuple[EdgeType, ...]
    partition: str = "date"

    def __post_init__(self) -> None:
        names = {n.name for n in self.nodes}
        if len(names) != len(self.nodes) or len({e.name for e in self.edges}) != len(self.edges):
            raise ValueError("type names repeat")
        for e in self.edges:
            if missing := {e.u_type, e.v_type} - names:
                raise ValueError(f"edge {e.name} names unknown node types: {sorted(missing)}")

    def node_index(self, name: str) -> int:
        return next(i for i, n in enumerate(self.nodes) if n.name == name)

    def edge_index(self, name: str) -> int:
        return next(i for i, e in enumerate(self.edges) if e.name == name)

    def node_names(self) -> dict[int, str]:
        return {i: n.name for i, n in enumerate(self.nodes)}

    def edge_names(self) -> dict[int, str]:
        return {i: e.name for i, e in enumerate(self.edges)}

    @classmethod
    def parse(cls, config: Mapping) -> GraphSchema:
        """From {nodes: {name: {table, id_column}}, edges: {name: {table, u_node: {type, id_column}, v_node: {..}}}}."""
        for key in ("nodes", "edges"):
            if not config.get(key):
                raise ValueError(f"the graph configuration needs {key}")
        nodes = tuple(NodeType(k, v["table"], v["id_column"]) for k, v in config["nodes"].items())
        edges = tuple(EdgeType(k, v["table"], v["u_node"]["type"], v["u_node"]["id_column"], v["v_node"]["type"], v["v_node"]["id_column"]) for k, v in config["edges"].items())
        parts = config.get("partition_columns", "date")
        return cls(nodes, edges, parts if isinstance(parts, str) else parts[0])


def read_config(path: str) -> dict:
    """JSON, or YAML where a YAML reader is installed."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML needs the yaml package; JSON works without it") from e
    return yaml.safe_load(text)
