"""Layered configuration (S11, K2, U5-U8, U14): global, project and local files, merged field by field."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from ..operators.embedding import EMBEDDERS
from ..schema import LANGUAGES


@dataclass(frozen=True)
class Source:
    language: str
    root: str
    dep: bool = False
    extensions: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.language not in LANGUAGES:
            raise ValueError(f"no language {self.language!r}")


@dataclass(frozen=True)
class Config:
    embedding_model: str | None = None
    exclude: tuple[str, ...] | None = None
    llm: dict | None = None
    sources: tuple[Source, ...] = field(default=())


def load(path: str | Path) -> Config | None:
    """None without the file; what can't be read raises."""
    path = Path(path)
    if not path.exists():
        return None
    raw = tomllib.loads(path.read_text(encoding="utf-8"))
    sources = tuple(Source(s["language"], s["root"], bool(s.get("dep", False)), tuple(s["extensions"]) if s.get("extensions") is not None else None) for s in raw.get("sources", []))
    exclude = raw.get("dependency", {}).get("exclude")
    return Config(raw.get("embedding", {}).get("model"), tuple(exclude) if exclude is not None else None, raw.get("llm"), sources)


def _toml(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"'


def save(config: Config, path: str | Path) -> None:
    """K2."""
    lines: list[str] = []
    if config.embedding_model is not None:
        lines += ["[embedding]", f"model = {_toml(config.embedding_model)}", ""]
    if config.exclude is not None:
        lines += ["[dependency]", f"exclude = {_toml(config.exclude)}", ""]
    if config.llm:
        lines += ["[llm]", *(f"{k} = {_toml(v)}" for k, v in config.llm.items()), ""]
    for s in config.sources:
        lines += ["[[sources]]", f"language = {_toml(s.language)}", f"root = {_toml(s.root)}", f"dep = {_toml(s.dep)}", *([f"extensions = {_toml(s.extensions)}"] if s.extensions is not None else []), ""]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines), encoding="utf-8")


def merge(*layers: Config | None) -> Config:
    """Later layers win field by field; sources are replaced as a whole when a layer has any."""
    out = Config()
    for x in layers:
        if x is not None:
            out = Config(
                x.embedding_model if x.embedding_model is not None else out.embedding_model, x.exclude if x.exclude is not None else out.exclude, x.llm if x.llm is not None else out.llm, x.sources or out.sources
            )
    return out


def resolved_sources(config: Config, project: str | Path) -> tuple[Source, ...]:
    """The configured sources, else one Rust source where a manifest lies, else none."""
    return config.sources or ((Source("rust", "."),) if (Path(project) / "Cargo.toml").exists() else ())


def with_source(config: Config, source: Source) -> Config:
    """U7."""
    return replace(config, sources=(*config.sources, source))


def without_source(config: Config, index: int) -> Config:
    """An index out of range raises IndexError."""
    if not 0 <= index < len(config.sources):
        raise IndexError(f"no source {index}; there are {len(config.sources)}")
    return replace(config, sources=config.sources[:index] + config.sources[index + 1 :])


def with_model(config: Config, name: str) -> Config:
    """U8: an unknown model raises ValueError."""
    if name not in EMBEDDERS:
        raise ValueError(f"no embedding model {name!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return replace(config, embedding_model=name)
