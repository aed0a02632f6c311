"""Glob patterns as regular expressions that Java and Python read alike."""

from __future__ import annotations

import re


def glob_regex(pattern: str, across: bool = False) -> str:
    """An anchored expression. across: whether * and ? also stand for a slash; ** always does.

    A set may be negated with !; an unclosed one is an ordinary bracket; a backslash makes the next character ordinary.
    """
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            if pattern[at : at + 1] == "*":
                at += 1
                out.append(".*")
            else:
                out.append(".*" if across else "[^/]*")
        elif c == "?":
            out.append("." if across else "[^/]")
        elif c == "\\" and at < len(pattern):
            out.append(re.escape(pattern[at]))
            at += 1
        elif c == "[" and (end := pattern.find("]", at + (pattern[at : at + 1] == "!"))) > at:
            body = pattern[at:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            if body.startswith("!"):
                body = "^" + body[1:]
            elif body.startswith("^"):
                body = "\\" + body
            out.append(f"[{body}]")
            at = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def is_valid(pattern: str) -> bool:
    try:
        re.compile(glob_regex(pattern))
    except re.error:
        return False
    return True
