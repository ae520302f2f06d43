"""Experiment configuration, from one table of what may be set.

A configuration file is nested YAML.  It is flattened to dotted names, each
name is looked up in ``SETTINGS``, and its value is checked by the setting's
own rule; what is not in the file has the table's value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

import yaml

from .registry import EMBEDDERS, INDEXES, Registry

#: A rule returns what is wrong with a value, or nothing.
Rule = Callable[[Any], str | None]


def _among(*allowed: str) -> Rule:
    return lambda v: None if v in allowed else f"{v!r} is none of {', '.join(allowed)}"


def _registered(registry: Registry) -> Rule:
    return lambda v: None if v in registry.names() else f"unknown {registry.kind} {v!r}; registered: {', '.join(registry.names())}"


def _whole(v: Any) -> str | None:
    return None if isinstance(v, int) and not isinstance(v, bool) else f"{v!r} is no whole number"


def _mapping(v: Any) -> str | None:
    return None if isinstance(v, dict) else f"{v!r} is no mapping"


# The names of the settings and what they are where a file does not say.
SETTINGS: dict[str, tuple[Any, Rule]] = {
    "corpus": ("dev", _among("dev", "full", "demo")),
    "chunking": ("sections", _among("sections", "whole_song")),
    "embedder.name": ("bge-m3", _registered(EMBEDDERS)),
    "embedder.params": ({}, _mapping),
    "index": ("numpy", _registered(INDEXES)),
    "retrieval.mode": ("dense", _among("dense", "lexical", "hybrid")),
    "retrieval.rrf_k": (60, _whole),
    "retrieval.top_k": (50, _whole),
    "retrieval.return_n": (10, _whole),
}
#: Settings that may be given in place of the group they belong to.
SHORT = {"embedder": "embedder.name"}


def _flat(value: Any, at: str = "") -> Iterator[tuple[str, Any]]:
    """Dotted names and values; a mapping is gone into unless it is a setting of its own."""
    if isinstance(value, dict) and at not in SETTINGS:
        for k, v in value.items():
            yield from _flat(v, f"{at}.{k}" if at else str(k))
    else:
        yield SHORT.get(at, at), value


@dataclass(frozen=True)
class Experiment:
    """A checked configuration; the fields are the last parts of the setting names."""

    corpus: str
    chunking: str
    embedder: str
    params: dict[str, Any]
    index: str
    mode: str
    rrf_k: int
    top_k: int
    return_n: int

    @classmethod
    def of(cls, given: dict[str, Any] | None = None) -> Experiment:
        """Raises ValueError naming every setting that is unknown or has a value its rule refuses."""
        if given is not None and not isinstance(given, dict):
            raise ValueError("a configuration is a mapping")
        values = {name: default for name, (default, _) in SETTINGS.items()}
        wrong = []
        for name, value in _flat(given or {}):
            if name not in SETTINGS:
                wrong.append(f"{name}: unknown setting")
            else:
                values[name] = value
        wrong += [f"{name}: {said}" for name, (_, rule) in SETTINGS.items() if (said := rule(values[name]))]
        if not wrong:
            missing = [p for p in EMBEDDERS.required(values["embedder.name"]) if p not in values["embedder.params"]]
            wrong += [f"embedder.params: {values['embedder.name']!r} needs {p}" for p in missing]
        if wrong:
            raise ValueError("; ".join(wrong))
        return cls(**dict(zip((f.name for f in fields(cls)), values.values(), strict=True)))


def load_config(path: str | Path) -> Experiment:
    return Experiment.of(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
