"""Adapters: all that is known of one bundler, as data and functions that others can add to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from bundlelens import rules
from bundlelens.js import unpack
from bundlelens.operators import payloads


@dataclass(frozen=True)
class Adapter:
    """name; signals of pages and scripts as in `rules`; how its chunks are unpacked, first come first served; hints:
    DataFrame functions from scripts (url, body) to (id, name, weight, reason)."""

    name: str
    page_signals: tuple = ()
    asset_signals: tuple = ()
    strategies: tuple[Callable, ...] = ()
    hints: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    owns_url: str = r"(?!)"  # URLs of other origins that are the site's own


@dataclass
class Registry:
    adapters: dict[str, Adapter] = field(default_factory=dict)

    def register(self, adapter: Adapter) -> Adapter:
        """Add an adapter; names are unique."""
        if adapter.name in self.adapters:
            raise ValueError(f"an adapter named {adapter.name!r} is there already")
        self.adapters[adapter.name] = adapter
        return adapter

    def names(self) -> list[str]:
        return sorted(self.adapters)

    def get(self, name: str | None) -> Adapter:
        """The adapter of that name, the generic one for null; ValueError for unknown ones."""
        if name is None:
            return self.adapters["generic"]
        if name not in self.adapters:
            raise ValueError(f"unknown adapter {name!r} (there are {', '.join(self.names())})")
        return self.adapters[name]

    def page_signals(self) -> list[tuple]:
        return [s for n in self.names() for s in self.adapters[n].page_signals]

    def hints(self, name: str | None, scripts: DataFrame) -> DataFrame:
        """All hints of an adapter's functions; no rows for those without any."""
        found = [f(scripts) for f in self.get(name).hints]
        empty = scripts.sparkSession.createDataFrame([], "id string, name string, weight double, reason string")
        for f in found:
            empty = empty.unionByName(f)
        return empty


def standard() -> Registry:
    """The adapters whose rules come with the engine."""
    hints = {"sveltekit": (payloads.kit_hints,), "vite": (payloads.file_name_hints,), "angular": (payloads.angular_hints,)}
    registry = Registry()
    for name in sorted({"generic", *unpack.STRATEGIES, *(s[0] for s in rules.PAGE_SIGNALS), *(s[0] for s in rules.ASSET_SIGNALS)}):
        registry.register(Adapter(name, tuple(s for s in rules.PAGE_SIGNALS if s[0] == name), tuple(s for s in rules.ASSET_SIGNALS if s[0] == name), unpack.STRATEGIES.get(name, ()), hints.get(name, ())))
    return registry
