"""Many globs at once: which rule of a list is the first that matches a path.

Rules that only fix a whole path, a beginning or an ending are looked up by hash: a path is probed once for each length that
such rules have, and each probe reads one small bucket, so the cost of a row grows with the distinct lengths and not with the
rules. The rest (inner wildcards, classes, alternatives) is one regular expression, compiled once for the query; only of
paths that it matches are its rules tried one by one. All of it is one JVM expression: no shuffle, no join, no Python.

The rules travel in the plan, some 40 bytes each: a list of 100,000 is 4 MB. Lists that grow with the data are tables; of
prefixes ``plans/rights.py`` makes an equi-join.
"""

from __future__ import annotations

import json
import zlib
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .globs import normalized, regex

WILD = set("*?[]{}\\")


class Probe(NamedTuple):
    """How a rule is looked up: its kind, and the text that the path has to have there."""

    kind: str
    text: str


def probe_of(pattern: str) -> Probe | None:
    """The lookup of a normalised glob, or None where only its regular expression tells.

    ``=`` the whole path, ``<`` a beginning, ``>`` an ending, ``/`` an ending that begins at a path component."""
    head = pattern.rstrip("*")
    if not WILD & set(pattern):
        return Probe("=", pattern)
    if not WILD & set(head):
        return Probe("<", head)
    anywhere = pattern.startswith("**/")
    tail = (pattern[3:] if anywhere else pattern).lstrip("*")
    if WILD & set(tail):
        return None
    if anywhere and not pattern[3:].startswith("*"):
        return Probe("/", f"/{tail}")
    # '**/**/q' is no ending in '/q': it matches a path 'q' as well
    return None if tail.startswith("/") and anywhere else Probe(">", tail)


def _buckets(keys: dict[str, int]) -> Column:
    """Rule numbers by key as a constant: an array of small maps, chosen by the key's crc32."""
    count = 1 << max(len(keys) - 1, 0).bit_length()
    held: list[dict[str, int]] = [{} for _ in range(count)]
    for key, rule in keys.items():
        held[zlib.crc32(key.encode()) % count][key] = rule
    return F.from_json(F.lit(json.dumps(held)), "array<map<string,int>>")


def first_rule(path: Column, patterns: list[str]) -> Column:
    """The number, from 0, of the first pattern that matches; null where none does or the path is null. An empty pattern is an error."""
    keys: dict[str, int] = {}
    lengths: dict[str, set[int]] = {"<": set(), ">": set(), "/": set()}
    rest: dict[str, int] = {}
    for rule, pattern in enumerate(map(normalized, patterns)):
        probe = probe_of(pattern)
        if probe is None:
            rest.setdefault(regex(pattern), rule)
            continue
        keys.setdefault(probe.kind + probe.text, rule)
        if probe.kind in lengths:
            lengths[probe.kind].add(len(probe.text))

    found = []
    if keys:
        table, count = _buckets(keys), 1 << max(len(keys) - 1, 0).bit_length()
        rooted = F.concat(F.lit("/"), path)
        cut = {
            "<": lambda n: F.concat(F.lit("<"), F.substr(path, F.lit(1), n)),
            ">": lambda n: F.concat(F.lit(">"), F.right(path, n)),
            "/": lambda n: F.concat(F.lit("/"), F.right(rooted, n)),
        }
        probes = [F.array(F.concat(F.lit("="), path))]
        probes += [F.transform(F.array(*map(F.lit, sorted(lengths[kind]))), cut[kind]) for kind in lengths if lengths[kind]]
        number = lambda key: F.try_element_at(F.get(table, F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(count)).cast("int")), key)
        found.append(F.array_min(F.transform(F.concat(*probes), number)))
    if rest:
        tried = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(pattern).alias("pattern")) for pattern, rule in rest.items()))
        number = F.array_min(F.transform(F.filter(tried, lambda r: F.rlike(path, r["pattern"])), lambda r: r["rule"]))
        found.append(F.when(F.rlike(path, F.lit("|".join(f"(?:{p})" for p in rest))), number))
    if not found:
        return F.lit(None).cast("int")
    return found[0] if len(found) == 1 else F.least(*found)


def allows(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """``globs.allows`` for long lists: includes before excludes; where none matches, a path stays unless there are includes."""
    rule = first_rule(path, [*include, *exclude])
    return F.coalesce(rule < len(include), F.lit(not include))
