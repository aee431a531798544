"""Settings in a TOML file, with defaults for what it leaves out."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Crawl:
    max_pages: int = 2_000_000
    concurrency: int = 200
    rate_limit_ms: int = 100


@dataclass(frozen=True)
class Embedding:
    model: str = "hashing"
    dim: int = 384
    batch_size: int = 1024
    max_length: int = 128


@dataclass(frozen=True)
class Index:
    backend: str = "ivf"
    cells: int = 64
    nprobe: int = 16


@dataclass(frozen=True)
class Chunking:
    context_depth: int = 3
    window_size: int = 3
    window_overlap: int = 1


@dataclass(frozen=True)
class Config:
    crawl: Crawl = field(default_factory=Crawl)
    embedding: Embedding = field(default_factory=Embedding)
    index: Index = field(default_factory=Index)
    chunking: Chunking = field(default_factory=Chunking)


def load(path: str | Path = "config.toml") -> Config:
    """The settings of a file; unknown names are an error, a missing file is not."""
    text = Path(path).read_text() if Path(path).exists() else ""
    given = tomllib.loads(text)
    kinds = {f.name: f.default_factory for f in fields(Config)}
    return Config(**{name: kinds[name](**section) for name, section in given.items()})
