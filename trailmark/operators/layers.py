"""Layers: named functions from tables to tables, run in the order of what they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BUILTIN = frozenset({"steps", "trajectories", "events", "judgments", "evidence"})


class LayerError(ValueError):
    pass


@dataclass(frozen=True)
class Layer:
    """``compute`` takes the tables it requires by name and gives those it writes."""

    name: str
    schemas: dict[str, T.StructType]
    compute: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    requires: tuple[str, ...] = ()


def registered(*libraries: dict[str, Layer]) -> dict[str, Layer]:
    """Layers by name, later libraries before earlier ones; no two may write one table."""
    found = {name: layer for library in libraries for name, layer in library.items()}
    writers: dict[str, str] = {}
    for name, layer in found.items():
        if layer.name != name:
            raise LayerError(f"{name} is called {layer.name}")
        for table in layer.schemas:
            if table in BUILTIN or table in writers:
                raise LayerError(f"{table} is written by {writers.get(table, 'the library')} and {name}")
            writers[table] = name
    return found


def plan(layers: dict[str, Layer], enabled: set[str] = frozenset(), tables: set[str] = frozenset()) -> list[Layer]:
    """The enabled layers, those that write ``tables``, and all they need, each after what it reads."""
    if unknown := sorted(set(enabled) - set(layers)):
        raise LayerError(f"unknown layers {unknown}")
    writer = {table: layer.name for layer in layers.values() for table in layer.schemas}

    def writers(wanted, by: str) -> set[str]:
        if lost := sorted(t for t in wanted if t not in writer and t not in BUILTIN):
            raise LayerError(f"{by} reads tables that no layer writes: {lost}")
        return {writer[t] for t in wanted if t in writer}

    needs: dict[str, set[str]] = {}
    todo = set(enabled) | writers(tables, "a query")
    while todo:
        name = todo.pop()
        needs[name] = writers(layers[name].requires, name)
        todo |= needs[name] - set(needs)
    try:
        order = TopologicalSorter({n: sorted(needs[n]) for n in sorted(needs)}).static_order()
        return [layers[n] for n in order]
    except CycleError as e:
        raise LayerError(f"layers need each other: {e.args[1]}") from e


def computed(order: list[Layer], given: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after running the layers; each must have the columns it declares."""
    tables = dict(given)
    for layer in order:
        made = layer.compute({t: tables[t] for t in layer.requires})
        if set(made) != set(layer.schemas):
            raise LayerError(f"{layer.name} wrote {sorted(made)}, not {sorted(layer.schemas)}")
        for table, schema in layer.schemas.items():
            want, got = [(f.name, f.dataType.simpleString()) for f in schema], made[table].dtypes
            if want != got:
                raise LayerError(f"{table} has {got}, not {want}")
        tables |= made
    return tables


def described(layers: dict[str, Layer]) -> str:
    """The tables and their columns as markdown; a column's comment is its description."""
    lines = []
    for layer in sorted(layers.values(), key=lambda x: x.name):
        for table, schema in sorted(layer.schemas.items()):
            lines += [f"## {table}", "", f"Written by `{layer.name}`.", "", "| Column | Type | What it holds |", "|-|-|-|"]
            lines += [f"| {f.name} | {f.dataType.simpleString()} | {(f.metadata or {}).get('comment', '')} |" for f in schema] + [""]
    return "\n".join(lines)
