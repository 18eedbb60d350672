"""Settings: environment over YAML-like mapping over defaults, with named profiles."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from .plans.search import Settings as SearchSettings

PREFIX = "RUNLOOM_"
SECRET = ("token", "password", "key", "secret")
DIMENSIONS = (128, 256, 512, 768)


@dataclass
class Chunking:
    max_tokens: int = 512
    min_tokens: int = 96
    overlap_tokens: int = 64

    def __post_init__(self) -> None:
        if self.min_tokens >= self.max_tokens:
            raise ValueError("min_tokens must be below max_tokens")


@dataclass
class Source:
    base_url: str = ""
    spaces: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    query: str = ""
    token: str = ""

    def __post_init__(self) -> None:
        self.base_url = self.base_url.rstrip("/")


@dataclass
class Embedding:
    provider: str = "hashing"
    #: A service's address; a model's name, or the folder that it is in.
    url: str = ""
    model: str = ""
    token: str = ""
    #: Texts in a request; 0 is the provider's own.
    batch: int = 0
    dimensions: int = 0

    def __post_init__(self) -> None:
        if self.dimensions and self.dimensions not in DIMENSIONS:
            raise ValueError(f"dimensions must be one of {DIMENSIONS}")


@dataclass
class Reranking:
    provider: str = "none"
    url: str = ""
    model: str = ""
    token: str = ""


@dataclass
class Logging:
    level: str = "info"
    form: str = "console"
    #: Seconds between reports of progress; 0 for none.
    progress_seconds: float = 10.0


@dataclass
class Config:
    folder: str = "warehouse"
    source: Source = field(default_factory=Source)
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    reranking: Reranking = field(default_factory=Reranking)
    logging: Logging = field(default_factory=Logging)
    retrieval: SearchSettings = field(default_factory=SearchSettings)

    def summary(self) -> dict[str, Any]:
        """All settings, secrets masked."""
        return _masked(asdict(self))


def _masked(x: Any, name: str = "") -> Any:
    if isinstance(x, dict):
        return {k: _masked(v, k) for k, v in x.items()}
    return "***" if x and isinstance(x, str) and any(s in name for s in SECRET) else x


def coerce(value: Any, default: Any) -> Any:
    """A text from the environment in the type of the default."""
    if not isinstance(value, str) or isinstance(default, str):
        return value
    if isinstance(default, bool):
        if value.strip().lower() in ("1", "true", "yes", "on"):
            return True
        if value.strip().lower() in ("0", "false", "no", "off"):
            return False
        raise ValueError(f"not a boolean: {value!r}")
    if isinstance(default, list):
        return [v.strip() for v in value.split(",") if v.strip()]
    return type(default)(value)


def load(mapping: dict[str, Any] | None = None, profile: str | None = None, env: dict[str, str] | None = None) -> Config:
    """``mapping``: sections of settings; a section may hold ``active`` and ``profiles``. RUNLOOM_SECTION_NAME overrides."""
    env = dict(os.environ if env is None else env)
    mapping = mapping or {}
    base = Config()
    if odd := set(mapping) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown sections {', '.join(sorted(odd))}")
    made: dict[str, Any] = {"folder": env.get(f"{PREFIX}FOLDER", mapping.get("folder", base.folder))}
    for f in fields(Config):
        if f.name == "folder":
            continue
        default = getattr(base, f.name)
        section = dict(mapping.get(f.name) or {})
        profiles, active = section.pop("profiles", {}), section.pop("active", None)
        chosen = profile if profile in profiles else active
        if chosen is not None:
            if chosen not in profiles:
                raise ValueError(f"{f.name}: no profile {chosen!r}; there are {', '.join(sorted(profiles)) or 'none'}")
            section |= profiles[chosen]
        known = {x.name: getattr(default, x.name) for x in fields(default)}
        if odd := set(section) - set(known):
            raise ValueError(f"{f.name}: unknown settings {', '.join(sorted(odd))}")
        for name, value in known.items():
            section[name] = coerce(env.get(f"{PREFIX}{f.name}_{name}".upper(), section.get(name, value)), value)
        made[f.name] = replace(default, **section)
    return Config(**made)


def found_above(name: str, start: str = ".") -> str | None:
    """The path of a file in a folder or in the nearest one above it."""
    at = os.path.abspath(start)
    while True:
        if os.path.isfile(path := os.path.join(at, name)):
            return path
        if at == (at := os.path.dirname(at)):
            return None


def load_files(path: str | None = None, profile: str | None = None, env: dict[str, str] | None = None, folder: str = ".") -> Config:
    """Settings of a YAML (or JSON) file: ``path``, else RUNLOOM_CONFIG, else ``runloom.yaml`` here or above.

    The environment wins over the nearest ``.env``, that over the file, and the file over the defaults. A file that is asked
    for has to be there. RUNLOOM_PROFILE names a profile where the caller doesn't.
    """
    dotenv = found_above(".env", folder)
    env = (read_dotenv(dotenv) if dotenv else {}) | dict(os.environ if env is None else env)
    path = path or env.get(f"{PREFIX}CONFIG") or found_above("runloom.yaml", folder)
    mapping: dict[str, Any] = {}
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            import json

            mapping = json.loads(text)
        else:
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("settings in YAML need the package pyyaml; JSON works without") from e
            mapping = yaml.safe_load(text) or {}
        if not isinstance(mapping, dict):
            raise ValueError(f"{path}: settings must be a mapping")
    return load(mapping, profile or env.get(f"{PREFIX}PROFILE"), env)


def read_dotenv(path: str) -> dict[str, str]:
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, eq, value = line.strip().partition("=")
            if eq and not name.startswith("#"):
                out[name.removeprefix("export ").strip()] = value.strip().strip("\"'")
    return out
