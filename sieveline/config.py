"""Settings: defaults, a global file and a project file, the latter winning value by value. Unknown names are errors."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

from sieveline.operators.report import parse_fail_on
from sieveline.schema import SEVERITIES

#: Fixed value: a larger settings file is refused.
LARGEST = 1 << 20


class ConfigError(ValueError):
    """Settings that cannot be used."""


@dataclass(frozen=True)
class Project:
    stack: str = "auto"


@dataclass(frozen=True)
class Check:
    fail_on: str = "high"
    score_badge: bool = False


@dataclass(frozen=True)
class Real:
    offline: bool = False
    check_apis: bool = True
    typosquat_sensitivity: str = "normal"


@dataclass(frozen=True)
class Audit:
    severity_min: str = "low"


@dataclass(frozen=True)
class Review:
    against: str = "HEAD"


@dataclass(frozen=True)
class Env:
    include_urls: bool = False
    env_file: str = ".env"


@dataclass(frozen=True)
class Snap:
    keep: int = 20
    auto_snap_before_fix: bool = True


@dataclass(frozen=True)
class Ship:
    target: str = "auto"
    run_build: bool = False


@dataclass(frozen=True)
class Update:
    channel: str = "stable"
    pin: str | None = None
    allow_downgrade: bool = False


@dataclass(frozen=True)
class Ignore:
    rules: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Baseline:
    file: str = ".baseline"
    auto: bool = False


@dataclass(frozen=True)
class Suppression:
    fingerprint: str
    reason: str


@dataclass(frozen=True)
class Config:
    project: Project = field(default_factory=Project)
    check: Check = field(default_factory=Check)
    real: Real = field(default_factory=Real)
    audit: Audit = field(default_factory=Audit)
    review: Review = field(default_factory=Review)
    env: Env = field(default_factory=Env)
    snap: Snap = field(default_factory=Snap)
    ship: Ship = field(default_factory=Ship)
    update: Update = field(default_factory=Update)
    ignore: Ignore = field(default_factory=Ignore)
    baseline: Baseline = field(default_factory=Baseline)
    suppress: tuple[Suppression, ...] = ()


#: Settings with a choice of words.
CHOICES = {("real", "typosquat_sensitivity"): ("off", "normal", "strict"), ("audit", "severity_min"): tuple(s for s, _, _ in SEVERITIES)}


def read_capped(path: str | Path, largest: int = LARGEST) -> str | None:
    """A small text file, None if there is none; a larger one, a folder or one that is not UTF-8 is an error."""
    path = Path(path)
    if not path.exists():
        return None
    if not path.is_file():
        raise ConfigError(f"{path}: not a file")
    with path.open("rb") as f:
        raw = f.read(largest + 1)
    if len(raw) > largest:
        raise ConfigError(f"{path}: larger than {largest} bytes")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        raise ConfigError(f"{path}: not UTF-8") from None


def parse(text: str, where: str = "settings") -> dict:
    """The raw settings of a text, checked for names, types and words."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{where}: {e}") from None
    known = {f.name: f for f in fields(Config)}
    for section, values in raw.items():
        if section not in known:
            raise ConfigError(f"{where}: unknown section {section}")
        if section == "suppress":
            for item in values if isinstance(values, list) else [None]:
                if not isinstance(item, dict) or set(item) != {"fingerprint", "reason"} or not all(isinstance(v, str) for v in item.values()):
                    raise ConfigError(f"{where}: suppress needs a fingerprint and a reason")
            continue
        if not isinstance(values, dict):
            raise ConfigError(f"{where}: {section} is a section")
        default = known[section].default_factory()
        for name, value in values.items():
            if name not in {f.name for f in fields(default)}:
                raise ConfigError(f"{where}: unknown setting {section}.{name}")
            kind = type(getattr(default, name)) if getattr(default, name) is not None else str
            good = isinstance(value, list) and all(isinstance(v, str) for v in value) if kind is tuple else type(value) is kind
            if not good or kind is int and value < 0:
                raise ConfigError(f"{where}: {section}.{name} has the wrong type")
            if (section, name) in CHOICES and value not in CHOICES[section, name]:
                raise ConfigError(f"{where}: {section}.{name} is one of {', '.join(CHOICES[section, name])}")
            if (section, name) == ("check", "fail_on"):
                try:
                    parse_fail_on(value)
                except ValueError as e:
                    raise ConfigError(f"{where}: {e}") from None
    return raw


def merge(project: dict, everywhere: dict) -> Config:
    """Settings value by value: the project's, else the global ones, else the defaults. Lists are taken whole."""
    made = {}
    for f in fields(Config):
        if f.name == "suppress":
            found = project.get("suppress", everywhere.get("suppress", []))
            made["suppress"] = tuple(Suppression(**x) for x in found)
            continue
        values = everywhere.get(f.name, {}) | project.get(f.name, {})
        made[f.name] = type(f.default_factory())(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
    return Config(**made)


def resolve(folder: str, named: str | None = None, everywhere: str | None = None, file: str = "sieveline.toml") -> Config:
    """The settings of a project folder; named: a file that must exist, in place of the project's; everywhere: the global file."""
    text = read_capped(named or Path(folder) / file)
    if named and text is None:
        raise ConfigError(f"{named}: there is no such file")
    other = read_capped(everywhere) if everywhere else None
    return merge(parse(text or "", named or file), parse(other or "", everywhere or ""))


def flat(config: Config) -> dict[str, object]:
    """Settings as section.name: value."""
    return {f"{s.name}.{f.name}": getattr(getattr(config, s.name), f.name) for s in fields(config) if is_dataclass(getattr(config, s.name)) for f in fields(getattr(config, s.name))}


def scopes(deps: bool = False, apis: bool = False, models: bool = False) -> tuple[str, ...]:
    """What a run looks at: all three without a choice, else the one that is chosen; two are an error."""
    chosen = [n for n, on in (("deps", deps), ("apis", apis), ("models", models)) if on]
    if len(chosen) > 1:
        raise ConfigError(f"only one of {', '.join(chosen)}")
    return tuple(chosen) or ("deps", "apis", "models")
