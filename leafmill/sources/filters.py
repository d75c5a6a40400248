"""Glob rules over relative paths: one regular expression per rule, evaluated in the scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is never indexed, and the reasons that are shown for files that no include rule matches.
IGNORED_FOLDERS = (".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", ".idea", ".vs")
NOT_TYPES_OR_NAMES, NOT_TYPES, NOT_NAMES = "Not one of the file types or names to include", "Not one of the file types to include", "Name doesn't match the include filters"
IGNORED_FILES = ("thumbs.db", "desktop.ini")


def glob_regex(pattern: str, watch: bool = False) -> str:
    """A case-insensitive full-match expression: ``**`` crosses folders, ``*`` and ``?`` do not, ``[!x]`` negates.

    A pattern without a slash applies at any depth; a trailing slash stands for everything below. The watcher's
    variant lets a bare name also match what lies below it and has no character classes.
    """
    body = pattern.strip().replace("\\", "/")
    below = body.endswith("/")
    body = body.strip("/")
    out, i = "", 0
    while i < len(body):
        rest = body[i:]
        if rest.startswith("**/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest.startswith("**"):
            out, i = out + ".*", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and not watch and (end := rest.find("]", 2)) > 0:
            inner = rest[1:end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", i + end + 1
        else:
            out, i = out + (rest[0] if rest[0].isalnum() or rest[0] in "_/ " else "\\" + rest[0]), i + 1
    anywhere = "" if "/" in body else "(?:.*/)?"
    tail = "/.*" if below else "(?:/.*)?" if watch and "/" not in body and not set("*?") & set(body) else ""
    return f"(?is)^{anywhere}{out}{tail}$"


@dataclass(frozen=True)
class Rules:
    """Rules as the settings hold them: ``!*.ext`` and ``!name`` include, the others exclude."""

    exclude: tuple[str, ...] = ()
    include_types: tuple[str, ...] = ()
    include_names: tuple[str, ...] = ()

    @classmethod
    def parse(cls, patterns: Sequence[str]) -> Rules:
        """Splits and deduplicates; an include without wildcards matches names that contain it."""
        ex, types, names = [], [], []
        for p in dict.fromkeys(x.strip() for x in patterns if x.strip()):
            if not p.startswith("!"):
                ex.append(p)
            elif p[1:].startswith("*.") and not set("*?/[") & set(p[3:]):
                types.append(p[1:])
            else:
                name = p[1:]
                names.append(name if set("*?[/") & set(name) else f"*{name}*")
        return cls(tuple(ex), tuple(types), tuple(names))


def any_glob(path: Column, patterns: Sequence[str], watch: bool = False) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p, watch))
    return out


def skip_reason(path: Column, rules: Rules) -> Column:
    """Why a rule skips the file, null if none does: the first exclude that matches, then missed includes."""
    excluded = F.coalesce(*[F.when(path.rlike(glob_regex(p)), F.lit(f"Excluded by rule: {p}")) for p in rules.exclude], F.lit(None).cast("string"))
    if not rules.include_types and not rules.include_names:
        return excluded
    missed = NOT_TYPES if not rules.include_names else NOT_NAMES if not rules.include_types else NOT_TYPES_OR_NAMES
    return F.coalesce(excluded, F.when(~any_glob(path, rules.include_types + rules.include_names), F.lit(missed)))


def ignored(path: Column) -> Column:
    """Built-in rules: tool folders, system files, lock files and hidden names."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    hidden = F.exists(parts, lambda p: p.startswith("."))
    folder = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*IGNORED_FOLDERS))
    return hidden | folder | name.isin(*IGNORED_FILES) | name.startswith("~$")


def size_reason(size: Column, max_mb: float) -> Column:
    return F.when(size > F.lit(int(max_mb * 1024 * 1024)), F.lit(f"Larger than {max_mb:g} MB"))
