"""Configuration: defaults, then a YAML file, then the environment; checked at the end."""

from __future__ import annotations

import os
import warnings
from dataclasses import asdict, dataclass, field
from pathlib import Path

import yaml

from ..catalog import MODELS

MODEL_VARIABLE, BATCH_VARIABLE = "TESSELAR_EMBEDDING_MODEL", "TESSELAR_BATCH_SIZE"
MOST_BYTES = 1 << 20


class ConfigError(ValueError):
    pass


@dataclass
class Embedding:
    model: str = "hashing"
    batch_size: int = 32


@dataclass
class Chunking:
    chunk_size: int = 1000
    chunk_overlap: int = 200


@dataclass
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)

    def check(self, environment: dict | None = None) -> Config:
        env = os.environ if environment is None else environment
        size, overlap, batch = self.chunking.chunk_size, self.chunking.chunk_overlap, self.embedding.batch_size
        if not 100 <= size <= 10_000:
            raise ConfigError(f"chunk_size must be between 100 and 10000, not {size}")
        if not 0 <= overlap < size:
            raise ConfigError(f"chunk_overlap must be at least 0 and below chunk_size, not {overlap}")
        if batch < 1:
            raise ConfigError(f"batch_size must be at least 1, not {batch}")
        if batch > 256:
            warnings.warn(f"batch_size {batch} is large", stacklevel=2)
        known = {m[0]: m for m in MODELS}
        if self.embedding.model not in known:
            warnings.warn(f"unknown embedding model {self.embedding.model}", stacklevel=2)
        elif (needs := known[self.embedding.model][4]) and not env.get(needs):
            raise ConfigError(f"model {self.embedding.model} needs {needs}")
        return self

    @property
    def chunk_config(self) -> dict[str, int]:
        return asdict(self.chunking)


def _file(path: Path) -> dict:
    """The mapping in a YAML file; a bad file counts as none."""
    if path.stat().st_size > MOST_BYTES:
        raise ConfigError(f"{path} is larger than {MOST_BYTES} bytes")
    try:
        found = yaml.safe_load(path.read_text(encoding="utf-8"))
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        warnings.warn(f"{path} is not readable: {e}", stacklevel=2)
        return {}
    return found if isinstance(found, dict) else {}


def load_config(path: str | None = None, environment: dict | None = None) -> Config:
    env, config = os.environ if environment is None else environment, Config()
    given = _file(Path(path)) if path and Path(path).exists() else {}
    for name, part in (("embedding", config.embedding), ("chunking", config.chunking)):
        values = given.get(name) if isinstance(given.get(name), dict) else {}
        for key, value in values.items():
            if hasattr(part, key):
                try:
                    setattr(part, key, type(getattr(part, key))(value))
                except (TypeError, ValueError) as e:
                    raise ConfigError(f"{name}.{key}: {value!r} is no {type(getattr(part, key)).__name__}") from e
            else:
                warnings.warn(f"unknown setting {name}.{key}", stacklevel=2)
    if extra := sorted(set(given) - {"embedding", "chunking"}):
        warnings.warn(f"unknown settings: {', '.join(map(str, extra))}", stacklevel=2)
    config.embedding.model = env.get(MODEL_VARIABLE) or config.embedding.model
    if (batch := env.get(BATCH_VARIABLE, "")).isdigit() and int(batch) > 0:
        config.embedding.batch_size = int(batch)
    return config.check(env)


def save_config(config: Config, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(asdict(config), sort_keys=False), encoding="utf-8")


def model_info(name: str | None = None) -> str:
    """A line for one model, or for all."""
    line = lambda m: f"{m[0]}: {m[5]} ({m[1]} dimensions, {m[2]} tokens, {m[3]}{f', needs {m[4]}' if m[4] else ''})"
    if name is None:
        return "\n".join(map(line, MODELS))
    return next((line(m) for m in MODELS if m[0] == name), f"{name}: unknown model")
