"""Settings of an engine, and their TOML form."""

from __future__ import annotations

import re
import tomllib
from dataclasses import asdict, dataclass, replace

from cloakframe import catalog as C

STRATEGIES = ("random_digits", "random_hex", "random_alphanumeric", "prefix_seq", "mask")


class EngineError(Exception):
    """Base of this package's errors."""


class ConfigError(EngineError):
    """A setting or rule can't be used."""


class CollisionError(EngineError):
    """Two originals would share a pseudonym."""


class FormatError(EngineError):
    """A document isn't in its format, or left it."""


class CryptoError(EngineError):
    """A container can't be opened."""


@dataclass(frozen=True)
class Rule:
    """A user's detector. Omitted matches are claimed but stay as they are."""

    name: str
    pattern: str
    prefix: str | None = None
    strategy: str = "random_digits"
    omitted: bool = False

    @property
    def usable(self) -> bool:
        try:
            re.compile(self.pattern)
        except re.error:
            return False
        return self.strategy in STRATEGIES


@dataclass(frozen=True)
class Config:
    key: str = "local-key"
    strict_word_boundaries: bool = True
    rules: tuple[Rule, ...] = ()
    #: Keys of the detectors in order of priority; those left out aren't used.
    priority: tuple[str, ...] = tuple(d.key for d in C.DETECTORS)
    protected_words: tuple[str, ...] = ()
    ignored_directories: tuple[str, ...] = tuple(C.IGNORED_DIRECTORIES)
    ignored_extensions: tuple[str, ...] = tuple(C.IGNORED_EXTENSIONS)
    #: Reproduce the originals' leaks: log lines with pairs are rewritten in the pairs' values only, bare JSON scalars not at all.
    parity: bool = True
    #: Registry entries that one matcher may hold; a larger registry is applied in several.
    matcher_entries: int = 200_000

    def with_rules(self, rules: list[Rule]) -> Config:
        """Adds rules whose names are new."""
        known = {r.name for r in self.rules}
        return replace(self, rules=(*self.rules, *[r for r in rules if r.name not in known]))


def rules_of(table: dict) -> list[Rule]:
    """Rules of a parsed TOML document, under `rules` or `custom_rules`."""
    out = []
    for r in [*table.get("rules", []), *table.get("custom_rules", [])]:
        try:
            out.append(Rule(r["name"], r["pattern"], r.get("prefix"), r.get("strategy", "random_digits"), bool(r.get("omitted", False))))
        except KeyError as e:
            raise ConfigError(f"a rule lacks {e}") from e
    return out


def load_rules(path: str) -> list[Rule]:
    with open(path, "rb") as f:
        return rules_of(tomllib.load(f))


def load_config(text: str) -> Config:
    """A configuration from TOML: general, ignore, rules."""
    try:
        table = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    general, ignore, out = table.get("general", {}), table.get("ignore", {}), Config()
    for name in ("key", "strict_word_boundaries", "parity"):
        if name in general:
            out = replace(out, **{name: general[name]})
    if "priority" in general:
        if unknown := set(general["priority"]) - set(C.BY_KEY):
            raise ConfigError(f"unknown detectors: {sorted(unknown)}")
        out = replace(out, priority=tuple(general["priority"]))
    for name in ("ignored_directories", "ignored_extensions"):
        if name in ignore:
            out = replace(out, **{name: tuple(ignore[name])})
    return out.with_rules(rules_of(table))


def rules_hash(config: Config) -> str:
    """Changes whenever a scan could find something else."""
    import hashlib
    import json

    part = {k: v for k, v in asdict(config).items() if k in ("rules", "priority", "protected_words", "strict_word_boundaries")}
    return hashlib.sha256(json.dumps(part, sort_keys=True).encode()).hexdigest()


def parse_selection(text: str, size: int) -> list[int]:
    """Row numbers (from 1) of a list such as `1, 3-5`; parts that aren't numbers or lie outside are left out."""
    out: set[int] = set()
    for part in text.split(","):
        if m := re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part):
            a, b = int(m[1]), int(m[2] or m[1])
            out |= set(range(max(1, min(a, b)), min(size, max(a, b)) + 1))
    return sorted(out)
