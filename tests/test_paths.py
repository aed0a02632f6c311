import re

import pytest

from quarrystone.operators.globs import glob_regex, is_valid
from quarrystone.operators import ignore
from quarrystone.operators.ignore import ignored, ignored_with_parents, parse_rule, rules_of, without_ignored
from tests.conftest import rows_of


@pytest.mark.parametrize(
    ("glob", "path", "inside", "across"),
    [
        ("*.txt", "a.txt", 1, 1), ("*.txt", "d/a.txt", 0, 1), ("**/a", "x/y/a", 1, 1), ("a?c", "abc", 1, 1), ("a?c", "a/c", 0, 1), ("[!a]b", "cb", 1, 1), ("[!a]b", "ab", 0, 0), ("[^a]b", "^b", 1, 1),
        ("[ab", "[ab", 1, 1), (r"\*", "*", 1, 1), (r"\*", "x", 0, 0), (r"[\]", "\\", 1, 1), ("a.b", "axb", 0, 0), ("[a-c]", "b", 1, 1), ("", "", 1, 1), ("a+b", "a+b", 1, 1), ("[]]", "[]]", 1, 1),
    ],
)
def test_globs(glob, path, inside, across):
    assert bool(re.search(glob_regex(glob), path)) == inside
    assert bool(re.search(glob_regex(glob, across=True), path)) == across


def test_invalid_glob():
    assert not is_valid("[z-a]") and is_valid("[a-z]")


def test_rules():
    assert parse_rule("# c") is None and parse_rule("  ") is None and parse_rule("/") is None
    r = parse_rule("!/foo/", "d")
    assert (r.base, r.negated, r.directories_only, r.name_only) == ("d", True, True, True)
    assert parse_rule(r"\#x").regex == "(?s)^\\#x$" and not parse_rule("a/b").name_only


def test_ignored(frame, monkeypatch):
    rules = rules_of([("sub", "!b.log\nx/*.txt"), ("", "*.log\nout/\n/top.md\n")])
    paths = ["a.log", "sub/b.log", "b.log", "out", "out/f", "d/out/f", "top.md", "deep/top.md", "sub/x/y/z.txt", "x/a.txt", "ok"]
    df = frame([(p,) for p in paths], "p string")
    got = {r.p for r in df.where(ignored_with_parents(df.p, rules)).collect()}
    assert got == {"a.log", "b.log", "out/f", "d/out/f", "top.md", "deep/top.md", "sub/x/y/z.txt"}
    assert df.where(ignored(df.p, [])).count() == 0
    few = rows_of(without_ignored(df.withColumnRenamed("p", "relative_path"), rules))
    monkeypatch.setattr(ignore, "IN_PLAN", 0)
    assert rows_of(without_ignored(df.withColumnRenamed("p", "relative_path"), rules)) == few == sorted((p,) for p in set(paths) - got)
