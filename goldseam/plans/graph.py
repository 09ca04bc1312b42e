"""Models that name what they are built from, built in that order, and again where something has changed."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from goldseam.sources.lake import Lake


@dataclass(frozen=True)
class Model:
    """A table of a layer, computed from the tables of ``refs``: other models, or Bronze tables."""

    name: str
    refs: tuple[str, ...]
    compute: Callable[[dict[str, DataFrame]], DataFrame]
    layer: str = "silver"
    kind: str = "table"


class ModelGraph:
    """Some models by name; what they refer to and is no model is a Bronze table."""

    def __init__(self, models: Iterable[Model]):
        self.models = {m.name: m for m in models}
        try:
            order = list(TopologicalSorter({m.name: m.refs for m in self.models.values()}).static_order())
        except CycleError as error:
            raise ValueError(f"models refer to each other: {' -> '.join(reversed(error.args[1]))}") from None
        self.order = [n for n in order if n in self.models]
        self.sources = sorted({r for m in self.models.values() for r in m.refs} - set(self.models))

    def below(self, changed: Iterable[str]) -> list[str]:
        """The models that are built from any of these, directly or not, and those of them that are models; in building order."""
        found = set(changed)
        unknown = found - set(self.models) - set(self.sources)
        if unknown:
            raise ValueError(f"no model refers to {sorted(unknown)}")
        for name in self.order:
            if found & set(self.models[name].refs):
                found.add(name)
        return [n for n in self.order if n in found]

    def build(self, lake: Lake, changed: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """Build all models whose tables exist, or only those below what has changed; returns those built.

        A model whose sources are missing is left out, and so is what is built from it.
        """
        wanted = self.order if changed is None else self.below(list(changed))
        built: dict[str, DataFrame] = {}
        for name in wanted:
            model = self.models[name]
            inputs = {r: built.get(r) if r in built else self._stored(lake, r) for r in model.refs}
            if any(df is None for df in inputs.values()):
                continue
            built[name] = lake.materialise(model.compute(inputs), name, model.layer, model.kind)
        return built

    def _stored(self, lake: Lake, name: str) -> DataFrame | None:
        layer = self.models[name].layer if name in self.models else "bronze"
        return lake.read(name, layer) if lake.exists(name, layer) else None
