"""Ignore files: rules like those of version control, the last match wins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.globs import glob_regex


@dataclass(frozen=True)
class IgnoreRule:
    """base: the folder of the rule's file, empty for the root. Without an inner slash a rule holds for names at any
    depth below its base, even if it began with a slash; with one, for the path from its base, where * crosses slashes."""

    base: str
    regex: str
    negated: bool
    directories_only: bool
    name_only: bool


def parse_rule(line: str, base: str = "") -> IgnoreRule | None:
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    if negated:
        text = text[1:]
    elif text[:2] in ("\\#", "\\!"):
        text = text[1:]
    directories_only = text.endswith("/")
    text = text.rstrip("/") if directories_only else text
    text = text.lstrip("/")
    if not text:
        return None
    name_only = "/" not in text
    return IgnoreRule(base, glob_regex(text, across=not name_only), negated, directories_only, name_only)


def rules_of(files: list[tuple[str, str]]) -> list[IgnoreRule]:
    """Rules of ignore files, given as (folder from the root, text), parents before children, folders by name."""
    ordered = sorted(files, key=lambda f: [p for p in f[0].split("/") if p])
    return [r for base, text in ordered for line in text.splitlines() if (r := parse_rule(line, base))]


def ignored(path: Column, rules: list[IgnoreRule], is_directory: bool | Column = False) -> Column:
    """Whether a path from the root is ignored. Rules come from files on the way, so there are few, and they become one
    expression: of the rules that match, the last decides."""
    out = F.lit(False)
    directory = F.lit(is_directory) if isinstance(is_directory, bool) else is_directory
    for r in rules:
        below = path if not r.base else F.substring(path, len(r.base) + 2, 1 << 30)
        inside = F.lit(True) if not r.base else path.startswith(r.base + "/")
        target = F.element_at(F.split(below, "/"), -1) if r.name_only else below
        hit = inside & target.rlike(r.regex)
        if r.directories_only:
            hit &= directory
        out = F.when(hit, F.lit(not r.negated)).otherwise(out)
    return out


def ignored_with_parents(path: Column, rules: list[IgnoreRule]) -> Column:
    """Whether a file, or a folder above it, is ignored."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.when(k < F.size(parts), F.array_join(F.slice(parts, 1, k), "/")))
    return ignored(path, rules) | F.exists(above, lambda p: F.coalesce(ignored(p, rules, True), F.lit(False)))


#: Rules up to which they become one expression of the plan.
IN_PLAN = 50


def _matcher(rules: list[IgnoreRule]):
    """ignored_with_parents for many rules: those of a path's own folders, by folder."""
    by_base: dict[str, list[tuple[re.Pattern[str], IgnoreRule]]] = {}
    for r in rules:
        by_base.setdefault(r.base, []).append((re.compile(r.regex), r))

    def decided(path: str, directory: bool) -> bool:
        out, parts = False, path.split("/")
        for k in range(len(parts)):
            below = "/".join(parts[k:])
            for pattern, r in by_base.get("/".join(parts[:k]), ()):
                if (directory or not r.directories_only) and pattern.search(parts[-1] if r.name_only else below):
                    out = not r.negated
        return out

    def any_ignored(path: str) -> bool:
        parts = path.split("/")
        return decided(path, False) or any(decided("/".join(parts[:k]), True) for k in range(1, len(parts)))

    return any_ignored


def without_ignored(rows: DataFrame, rules: list[IgnoreRule]) -> DataFrame:
    """The rows whose relative_path no rule ignores; many rules are matched in the tasks, as a plan could not hold them."""
    if len(rules) <= IN_PLAN:
        return rows.where(~ignored_with_parents(F.col("relative_path"), rules))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matches = _matcher(rules)
        for b in batches:
            yield b[[not matches(p) for p in b.relative_path]]

    return rows.mapInPandas(keep, rows.schema)
