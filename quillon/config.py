"""Settings: defaults, then the system's, the user's and the folder's TOML file, each over the one before."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class Search:
    strategy: str = "hybrid"
    limit: int = 10
    shortlist: int = 8


@dataclass
class Embedding:
    model: str = "hash"
    max_length: int = 40
    width: int = 384


@dataclass
class Rerank:
    model: str | None = None
    max_length: int = 512


@dataclass
class Prompts:
    hyde: str | None = None
    splade: str | None = None
    classified: str | None = None


@dataclass
class Config:
    search: Search = field(default_factory=Search)
    embedding: Embedding = field(default_factory=Embedding)
    rerank: Rerank = field(default_factory=Rerank)
    prompts: Prompts = field(default_factory=Prompts)

    def merged(self, data: dict) -> Config:
        """With the known fields that data has; [model] is an old name of [embedding]."""
        if "model" in data and "embedding" not in data:
            data = {**data, "embedding": data["model"]}
        for part in fields(self):
            own = getattr(self, part.name)
            for f in fields(own):
                if f.name in (data.get(part.name) or {}):
                    setattr(own, f.name, data[part.name][f.name])
        return self

    def as_toml(self) -> str:
        out = []
        for part, values in asdict(self).items():
            lines = [f"{k} = {v}" if isinstance(v, int) else f'{k} = "{v}"' for k, v in values.items() if v is not None]
            out.append("\n".join([f"[{part}]", *lines]))
        return "\n\n".join(out) + "\n"


def files(folder: str = ".") -> list[Path]:
    own = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    return [Path("/etc/quillon.toml"), own / "quillon" / "config.toml", Path(folder) / "quillon.toml"]


def load(folder: str = ".", paths: list[Path] | None = None) -> Config:
    out = Config()
    for path in files(folder) if paths is None else paths:
        if path.is_file():
            out.merged(tomllib.loads(path.read_text(encoding="utf-8")))
    return out


def cache_dir(kind: str = "index") -> Path:
    """Folder for stored state: from QUILLON_<KIND>_DIR, QUILLON_CACHE, XDG_CACHE_HOME or the home folder."""
    if own := os.environ.get(f"QUILLON_{kind.upper()}_DIR"):
        return Path(own)
    root = os.environ.get("QUILLON_CACHE") or os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.join(Path.home(), ".cache"), "quillon")
    return Path(root) / kind
