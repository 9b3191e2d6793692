"""Configuration read by the driver: profiles, specs, domain maps, limits from the environment."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from corpusmill.operators.paths import DOMAINS


def parse_domain_map(text: str, name: str, kind: type = float) -> dict[str, Any]:
    """``logic=0.2,code=0.3`` as a dict; blanks are ignored, unknown domains refused."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, sign, value = part.partition("=")
        key = key.strip().lower()
        if not sign or key not in DOMAINS:
            raise ValueError(f"{name}: {part!r} is not a domain and a value; domains are {', '.join(DOMAINS)}")
        out[key] = kind(value.strip())
    return out


def profiles(built_in: Mapping[str, dict], path: str | None = None) -> dict[str, dict]:
    """Built-in profiles, overlaid key by key by those of a JSON file."""
    merged = {name: dict(values) for name, values in built_in.items()}
    if path:
        with open(path, encoding="utf-8") as f:
            for name, values in json.load(f).items():
                merged[name] = merged.get(name, {}) | values
    return merged


def resolve_profile(profile: Mapping[str, Any], weights: Mapping[str, float] | None = None, quotas: Mapping[str, int] | None = None) -> dict[str, Any]:
    """Sizes, normalised weights and quotas: overridden weights are merged and scaled before quotas are drawn from them; stated quotas hold as they are."""
    from corpusmill.operators.sampling import normalise_weights

    own = normalise_weights({**profile["domain_weights"], **(weights or {})})
    total = int(profile["input_sentence_size"])
    exact = {d: own[d] * total for d in DOMAINS}
    drawn = {d: int(exact[d]) for d in DOMAINS}
    for d in sorted(DOMAINS, key=lambda d: drawn[d] - exact[d])[: total - sum(drawn.values())]:
        drawn[d] += 1
    return {**profile, "domain_weights": own, "quotas": {**drawn, **(quotas or {})}}


def read_specs(path: str, default_rows: int) -> list[dict]:
    """Pillar specs: a JSON list, or an object with ``pillars``; rows and selection get defaults."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    specs = found["pillars"] if isinstance(found, dict) else found
    return [{"rows": default_rows, "selection": "head"} | s for s in specs]


#: Keys that a spec needs, and those of the types of its source.
SPEC_KEYS = ("name", "output_subdir", "output_file", "source_type", "rows", "selection")
SOURCE_KEYS = {"hf_dataset": ("dataset", "split"), "fineweb_glob": ("file_glob",)}


def check_specs(specs: list[dict]) -> None:
    for s in specs:
        if missing := [k for k in (*SPEC_KEYS, *SOURCE_KEYS.get(s.get("source_type", ""), ())) if k not in s]:
            raise ValueError(f"spec {s.get('name', '?')} lacks {', '.join(missing)}")
        if s["source_type"] not in SOURCE_KEYS:
            raise ValueError(f"spec {s['name']}: unknown source type {s['source_type']!r}")
        try:
            rows = int(s["rows"])
        except (TypeError, ValueError) as bad:
            raise ValueError(f"spec {s['name']}: rows must be a positive integer") from bad
        if rows <= 0:
            raise ValueError(f"spec {s['name']}: rows must be a positive integer")


class Presets:
    """Named sets of specs: a description, and a function that builds the specs from its settings."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[str, Callable[..., list[dict]]]] = {}

    def add(self, name: str, description: str, build: Callable[..., list[dict]]) -> None:
        self._known[name] = (description, build)

    def descriptions(self) -> dict[str, str]:
        return {name: description for name, (description, _) in sorted(self._known.items())}

    def specs(self, name: str, **settings: Any) -> list[dict]:
        """The checked specs of a preset; an unknown name is refused with those that are known."""
        if name not in self._known:
            raise ValueError(f"unknown preset {name!r}; known are {', '.join(sorted(self._known))}")
        specs = self._known[name][1](**settings)
        check_specs(specs)
        return specs


def provenance(spec: dict) -> dict:
    """A spec without the keys that say where it is written."""
    return {k: v for k, v in spec.items() if k not in ("output_subdir", "output_file")}


def corpus_bytes(ram_gb: float, reserved_gb: float = 4.0) -> int:
    """Bytes of text that memory allows."""
    return int(max(ram_gb - reserved_gb, 0.5) * 2**30)


def scaled_size(base: int, ram_gb: float | None, cap: int = 2_800_000, low: float = 13.0, high: float = 30.0) -> int:
    """A sample size that grows with memory from ``base`` at ``low`` to ``cap`` at ``high`` GB."""
    if ram_gb is None or ram_gb <= low:
        return base
    return max(base, min(cap, int(base + (ram_gb - low) * (cap - base) / (high - low))))


def env_int(env: Mapping[str, str], name: str, default: int, least: int | None = None) -> int:
    try:
        value = int(env.get(name, ""))
    except ValueError:
        return default
    return default if least is not None and value < least else value


def env_flag(env: Mapping[str, str], name: str, default: bool = False) -> bool:
    raw = env.get(name)
    return default if raw is None else raw.strip().lower() in ("1", "true", "yes", "on")
