"""Include and exclude globs as one boolean expression over a path column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(pattern: str) -> str:
    """A pattern as it is matched: '/' as separator, no leading './' or '/', folders match all below, bare names match anywhere."""
    out = pattern.strip().replace("\\", "/").removeprefix("./").removeprefix("/")
    if not out:
        raise ValueError("empty pattern")
    if out.endswith("/"):
        out += "**"
    return out if "/" in out else f"**/{out}"


def regex(pattern: str) -> str:
    """Java regular expression of a normalised glob; '*' and '?' cross '/', '**/' also matches nothing."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            out += ".*"
            while pattern.startswith("*", i + 1):
                i += 1
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + (3 if pattern[i + 1 : i + 2] in ("!", "^") else 2))) > 0:
            body = pattern[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if negated else body)
            out, i = f"{out}[{'^' if negated else ''}{body}]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed '{{' in {pattern!r}")
    return f"(?s)^{out}\\z"


def allows(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Keep a path: all includes are tried before all excludes; where none matches, it stays unless there are includes."""
    hit = lambda patterns: F.lit(False) if not patterns else F.rlike(path, F.lit("|".join(f"(?:{regex(normalized(p))})" for p in patterns)))
    return F.when(hit(include), True).when(hit(exclude), False).otherwise(not include)
