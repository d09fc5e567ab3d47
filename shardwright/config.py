"""Settings of the operators: plain values with defaults, or from an environment mapping."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


def csv(value: str | None, default: str) -> tuple[str, ...]:
    """A comma list with items stripped and empty ones dropped; an empty value means the default."""
    return tuple(x.strip() for x in (value or default).split(",") if x.strip())


@dataclass(frozen=True)
class CorpusConfig:
    collections: tuple[str, ...] = ("gotchas", "decisions", "security", "tasks", "repos")
    areas: tuple[str, ...] = ("backend", "frontend", "mobile", "infra", "cross")
    platforms: tuple[str, ...] = ("claude", "codex", "gemini", "cursor")
    template: str = "_SHARD_TEMPLATE.md"
    project: str = "project"
    marker: str = "generated by shardwright"
    marker_window: int = 10

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> CorpusConfig:
        d = cls()
        return cls(areas=csv(env.get("KB_AREAS"), ",".join(d.areas)), platforms=csv(env.get("KB_PLATFORMS"), ",".join(d.platforms)), project=env.get("KB_PROJECT") or d.project)


@dataclass(frozen=True)
class LintConfig:
    # The schema of a record, as lint has it by default.
    required: tuple[str, ...] = ("name", "type", "title", "status", "updated", "volatility", "provenance")
    recommended: tuple[str, ...] = ("area", "tags")
    types: tuple[str, ...] = ("gotcha", "decision", "security", "task", "repo", "architecture", "reference")
    status: tuple[str, ...] = ("active", "superseded", "resolved")
    volatility: tuple[str, ...] = ("durable", "decays-with-code", "one-shot")
    # Leftovers of an unfilled template.
    placeholders: tuple[str, ...] = ("{PROJECT}", "example-slug-kebab-case", "Copy this file, rename", "One-line, specific, human-readable title", "2–5 tight sentences")
    max_lines: int = 120
    strict: bool = False

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> LintConfig:
        """These lists are split and not stripped: a spaced item is another value."""
        d = cls()
        part = lambda k, v: tuple((env.get(k) or ",".join(v)).split(","))
        return cls(types=part("KB_TYPES", d.types), status=part("KB_STATUS", d.status), volatility=part("KB_VOLATILITY", d.volatility), max_lines=int(env.get("KB_MAX_LINES", "120")), strict=env.get("KB_STRICT") == "1")


@dataclass(frozen=True)
class StaleConfig:
    days: int = 14
    today: str | None = None
    # Extensions of cited source files, and folders that the code index leaves out.
    extensions: tuple[str, ...] = ("ts", "tsx", "js", "jsx", "rs", "py", "go", "sh", "toml", "yaml", "yml", "sql", "rb", "java", "kt", "swift", "c", "h", "cpp", "json")
    pruned: tuple[str, ...] = (".git", "node_modules", "dist", "build", "target")

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> StaleConfig:
        return cls(days=int(env.get("KB_STALE_DAYS", "14")), today=env.get("KB_TODAY") or None)


@dataclass(frozen=True)
class DigestConfig:
    match: str = ""
    cap: int = 4000
    head: int = 200_000
    least: int = 12
    buckets: tuple[tuple[str, str], ...] = field(default=())

    @classmethod
    def from_options(cls, match: str, cap: int = 4000, buckets: str = "") -> DigestConfig:
        return cls(match=match, cap=cap, buckets=cls.rules(buckets))

    @staticmethod
    def rules(spec: str) -> tuple[tuple[str, str], ...]:
        """name=part,name2=part2: parts without `=` are left out, what a rule looks for is lower-cased."""
        pairs = (x.split("=", 1) for x in spec.split(",") if "=" in x)
        return tuple((n.strip(), s.strip().lower()) for n, s in pairs)
