"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed up by cell (source, language, topic). The cells' probabilities
are raked: one factor for each source, language and topic is adjusted in turn until
the kept tokens of every one of them meet its target. No probability exceeds 1: a
cell that would is kept whole and the raking goes on with the others, so targets
still hold. A source, language or topic that has fewer tokens than its target is kept
whole, and what it lacks goes to the others of its margin by their shares. Where the
three margins cannot be met together at the budget asked for, the largest budget at
which they can is taken; where at none, the closest fit is, with a warning and
``met`` false. A document is kept with its cell's probability, decided by a digest of
its id, so a repeated run or a lost task decides alike.

Targets are shares by value; what the named ones leave of 1 goes to the values
without a name, by their shares in the data to the power ``temperature``. If they
leave nothing, documents of other values have probability 0.

Up to MAX_CELLS cells are raked on the driver. More of them (web hosts as sources) stay
in Spark, dealt by the margin of most values: given the other margins' factors, the
factor of each of its values depends on the value's own cells only, so tasks solve for
it, and a round is one pass that brings back the sums of the other two margins. The
driver holds factors of these two margins, never cells.

Defined cases: a null source, language or topic counts as the value ''; a null
token weight as 0; values that the data lack give up their share to the others of
the margin; repeated rows share id and fate; an empty table gives an empty result;
input columns that have the name of the result column are replaced.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .names import column, fresh
from .skew import join_by_size

MAX_CELLS = 1 << 16
ROUNDS, TOLERANCE, HALVINGS = 400, 1e-6, 20
SEED = 20240611
MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mix:
    """Target shares by margin, and the tokens to keep, in expectation, as a share of all."""

    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    temperature: float = 0.7
    budget: float = 0.6
    seed: int = SEED


class Fit(NamedTuple):
    """Probability of each cell, and whether the margins of what is kept meet their targets."""

    probability: np.ndarray
    met: bool


def shares(values: list[str], tokens: np.ndarray, named: dict[str, float], temperature: float) -> np.ndarray:
    """Target shares of a margin's values, which hold ``tokens``."""
    if not all(x >= 0 for x in named.values()) or sum(named.values()) > 1 + 1e-9:
        raise ValueError("target shares must be 0 or more and add up to 1 at most")
    fixed = np.array([named.get(v, 0.0) for v in values])
    free = np.array([v not in named for v in values], bool) & (tokens > 0)
    spread = np.where(free, tokens, 0.0) ** temperature * free
    rest = max(0.0, 1 - sum(named.values()))
    out = fixed + (rest * spread / spread.sum() if free.any() else 0.0)
    return out / max(out.sum(), 1e-300)


def supplied(share: np.ndarray, have: np.ndarray, wanted: float) -> np.ndarray:
    """``wanted`` tokens by these shares, but of no value more than it has: the others take over what it lacks."""
    whole = np.zeros(len(share), bool)
    while True:
        left = np.where(whole, 0.0, share)
        out = np.where(whole, have, max(0.0, wanted - have[whole].sum()) * left / max(left.sum(), 1e-300))
        short = (out > have) & ~whole
        if not short.any():
            return out
        whole |= short


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Fit:
    """Probabilities of at most 1 with which each margin's kept tokens are ``targets`` (in tokens, all of one sum)."""
    total = max(targets[0].sum(), 1e-300)
    factors = [np.full(len(t), 1.0) for t in targets]
    factors[0] *= total / max(tokens.sum(), 1e-300)
    chance = lambda: np.minimum(1.0, np.prod([f[c] for f, c in zip(factors, codes)], axis=0))
    for _ in range(rounds):
        worst = 0.0
        for f, code, target in zip(factors, codes, targets):
            now = np.bincount(code, tokens * chance(), len(target))
            worst = max(worst, float(np.abs(now - target).max()) / total)
            f *= np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            np.clip(f, 0, 1e12, out=f)
        if worst < tolerance:
            return Fit(chance(), True)
    return Fit(chance(), False)


def calibrated(cells: list[dict], mix: Mix) -> tuple[list[tuple[str, str, str, float]], bool, float]:
    """(source, lang, topic, probability) of every cell, whether the targets are met, and the budget in tokens."""
    if not cells:
        return [], True, 0.0
    tokens = np.array([c["tokens"] for c in cells], float)
    codes, goals = [], []
    for m in MARGINS:
        values = sorted({c[m] for c in cells})
        place = {v: k for k, v in enumerate(values)}
        codes.append(np.array([place[c[m]] for c in cells]))
        goals.append(shares(values, np.bincount(codes[-1], tokens), mix.targets.get(m, {}), mix.temperature))
    have = [np.bincount(c, tokens) for c in codes]
    goal = lambda budget: [supplied(g, h, budget) for g, h in zip(goals, have)]
    wanted = min(mix.budget * tokens.sum(), *(float(h[g > 0].sum()) for g, h in zip(goals, have)))
    fit = rake(tokens, codes, goal(wanted))
    if not fit.met:  # the largest budget that can be met, by halving
        low, high, best = 0.0, wanted, None
        for _ in range(HALVINGS):
            middle = (low + high) / 2
            tried = rake(tokens, codes, goal(middle))
            if tried.met:
                low, best = middle, tried
            else:
                high = middle
        if best is None:
            warnings.warn("the targets of source, language and topic cannot be met together; the mixture is the closest fit", stacklevel=2)
        else:
            fit, wanted = best, low
    return [(*(c[m] for m in MARGINS), float(p)) for c, p in zip(cells, fit.probability)], fit.met, wanted


def cells_of(rows: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens, docs) of all cells, stored."""
    return stored(rows.groupBy(*MARGINS).agg(F.sum("n").cast("double").alias("tokens"), F.count("*").alias("docs")), "cells")


def supplied_in_spark(values: DataFrame, budget: float) -> DataFrame:
    """``supplied`` for (value, share, have): with the column goal."""
    factor, whole = 0.0, F.lit(False)
    while True:  # each round keeps at least one more value whole; values fall short by their shares, so rounds are few
        kept, left = values.agg(F.sum(F.when(whole, F.col("have")).otherwise(0.0)), F.sum(F.when(whole, 0.0).otherwise(F.col("share")))).first()
        higher = max(0.0, budget - kept) / max(left, 1e-300)
        if higher <= factor * (1 + 1e-12):
            return values.withColumn("goal", F.least("have", F.col("share") * F.lit(factor)))
        factor = higher
        whole = F.col("have") < F.col("share") * F.lit(factor)


def solved(goal: np.ndarray, tokens: np.ndarray, weight: np.ndarray, owner: np.ndarray, steps: int = 60) -> np.ndarray:
    """For each owner the factor f at which its cells keep ``goal`` in all: sum of tokens * min(1, f * weight)."""
    n = len(goal)
    kept = lambda f: np.bincount(owner, tokens * np.minimum(1.0, f[owner] * weight), n)
    low, high = np.full(n, -60.0), np.full(n, 60.0)  # powers of two
    for _ in range(steps):
        middle = (low + high) / 2
        less = kept(np.exp2(middle)) < goal
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return np.where(goal > 0, np.exp2(high), 0.0)


def _blocks(batches):
    """Whole values of the dealt margin at a time: their cells come together."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        names = table.column("value").to_numpy(zero_copy_only=False)
        at = int(np.flatnonzero(names == names[-1])[0]) if len(names) else 0
        if at:
            yield table.slice(0, at)
        rest = table.slice(at)
    if rest is not None and rest.num_rows:
        yield rest


def raked_in_spark(cells: DataFrame, mix: Mix, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, bool]:
    """``cells`` with their probability, and whether the targets are met."""
    spark = cells.sparkSession
    counts = cells.agg(*(F.count_distinct(m).alias(m) for m in MARGINS), F.sum("tokens").alias("all")).first()
    dealt = max(MARGINS, key=lambda m: counts[m])
    others = [m for m in MARGINS if m != dealt]
    goals, have = [], []
    for m in others:  # on the driver: the two margins of fewer values
        found = cells.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("have")).orderBy("value").toArrow()
        values, own = found.column(0).to_pylist(), found.column(1).to_numpy()
        have.append((values, own))
        goals.append(shares(values, own, mix.targets.get(m, {}), mix.temperature))
    named = mix.targets.get(dealt, {})
    shares([], np.zeros(0), named, mix.temperature)
    fixed = spark.createDataFrame([(k, float(v)) for k, v in named.items()], "value string, named double")
    values = cells.groupBy(F.col(dealt).alias("value")).agg(F.sum("tokens").alias("have")).join(F.broadcast(fixed), "value", "left")  # named targets only
    values = values.withColumn("spread", F.when(F.col("named").isNull(), F.pow("have", F.lit(mix.temperature))).otherwise(0.0))
    spread, there = values.agg(F.sum("spread"), F.sum(F.coalesce("named", F.lit(0.0)))).first()
    rest = max(0.0, 1 - sum(named.values())) if spread else 0.0
    share = (F.coalesce("named", F.lit(0.0)) + (F.col("spread") * F.lit(rest / spread) if spread else F.lit(0.0))) / F.lit(max(there + rest, 1e-300))
    values = stored(values.select("value", "have", share.alias("share")), "values")
    most = values.filter("share > 0").agg(F.coalesce(F.sum("have"), F.lit(0.0))).first()[0]
    wanted = min(mix.budget * counts["all"], most, *(float(h[g > 0].sum()) for g, (_, h) in zip(goals, have)))

    def attempt(budget: float) -> tuple[DataFrame, bool]:
        of = cells.withColumnRenamed(dealt, "value").join(supplied_in_spark(values, budget).select("value", "goal"), "value")
        table = stored(of.select("value", "goal", *(F.col(m).alias(f"m{i}") for i, m in enumerate(others)), "tokens").repartition("value").sortWithinPartitions("value"), "dealt")
        targets = [supplied(g, h, budget) for g, (_, h) in zip(goals, have)]
        factors = [np.ones(len(t)) for t in targets]
        met = False
        for _ in range(rounds):
            worst = 0.0
            for turn in range(len(others)):
                now = np.zeros(len(targets[turn]))
                found = table.repartition("value").sortWithinPartitions("value").mapInArrow(_pass(factors, [v for v, _ in have], turn), "code long, kept double").groupBy("code").agg(F.sum("kept").alias("kept")).toArrow()
                now[found.column(0).to_numpy()] = found.column(1).to_numpy()
                worst = max(worst, float(np.abs(now - targets[turn]).max()) / max(budget, 1e-300))
                factors[turn] = np.clip(factors[turn] * np.divide(targets[turn], now, out=np.zeros_like(now), where=now > 0), 0, 1e12)
            if worst < tolerance:
                met = True
                break
        out = table.repartition("value").sortWithinPartitions("value").mapInArrow(_pass(factors, [v for v, _ in have], None), f"`{dealt}` string, `{others[0]}` string, `{others[1]}` string, probability double")
        return out, met

    found, met = attempt(wanted)
    low, high = 0.0, wanted
    for _ in range(0 if met else HALVINGS):
        middle = (low + high) / 2
        tried, ok = attempt(middle)
        if ok:
            low, found, met = middle, tried, True
        else:
            high = middle
    if not met:
        warnings.warn("the targets of source, language and topic cannot be met together; the mixture is the closest fit", stacklevel=2)
    return found, met


def _pass(factors: list[np.ndarray], names: list[list[str]], turn: int | None):
    """A task over cells dealt by their value: what the values of margin ``turn`` keep, or (None) the cells' probabilities."""

    def task(batches):
        places = [pa.array(n, pa.string()) for n in names]
        total = None if turn is None else np.zeros(len(factors[turn]))
        for table in _blocks(batches):
            value = table.column("value").combine_chunks().dictionary_encode()
            owner = value.indices.to_numpy()
            codes = [pc.index_in(table.column(f"m{i}"), value_set=p).to_numpy() for i, p in enumerate(places)]
            weight, tokens = factors[0][codes[0]] * factors[1][codes[1]], table.column("tokens").to_numpy()
            goal = np.zeros(len(value.dictionary))
            goal[owner] = table.column("goal").to_numpy()
            chance = np.minimum(1.0, solved(goal, tokens, weight, owner)[owner] * weight)
            if turn is None:
                yield from pa.Table.from_arrays([table.column("value"), table.column("m0"), table.column("m1"), pa.chunked_array([chance])], names=["a", "b", "c", "d"]).to_batches()
            else:
                total += np.bincount(codes[turn], tokens * chance, len(total))
        if turn is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["code", "kept"])

    return task


def drawn(key: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 that depends on seed and key alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_sources(
    df: DataFrame, tokens: Column, topic: Column, mix: Mix = Mix(), key: str = "doc_id", source: str = "source", lang: str = "lang", out: str = "mix", weighed: DataFrame | None = None
) -> DataFrame:
    """``df`` with a struct column ``out`` of topic, probability, kept and met.

    ``weighed``: the rows (source, lang, topic, n) whose tokens are raked, where they come cheaper than from ``df`` itself."""
    names = [c for c in df.columns if c != out]
    value = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    margin = dict(zip(MARGINS, (value(column(source)), value(column(lang)), value(topic))))
    if weighed is None:
        weighed = df.select(*(margin[m].alias(m) for m in MARGINS), F.coalesce(tokens, F.lit(0)).alias("n"))
    else:
        weighed = weighed.select(*(value(F.col(m)).alias(m) for m in MARGINS), "n")
    cells = cells_of(weighed)
    with_tokens = cells.filter("tokens > 0")
    own = fresh(df, *MARGINS, "probability")
    found = with_tokens.limit(MAX_CELLS + 1).toArrow()
    if found.num_rows <= MAX_CELLS:
        rows, met, _ = calibrated(sorted(found.to_pylist(), key=lambda c: tuple(c[m] for m in MARGINS)), mix)
        table = df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in zip(own, ("string", "string", "string", "double"))))
        where = [margin[m] == F.col(c) for m, c in zip(MARGINS, own)]
        joined = df.join(F.broadcast(table), where[0] & where[1] & where[2], "left")  # MAX_CELLS rows at most
    else:
        raked, met = raked_in_spark(with_tokens, mix)
        every = stored(cells.join(raked, list(MARGINS), "left").select(F.struct(*MARGINS).alias("cell"), F.coalesce("probability", F.lit(0.0)).alias("p"), "docs"), "rates")
        cell, size = fresh([*df.columns, *own], "cell", "size")
        rows = df.withColumn(cell, F.struct(*(margin[m].alias(m) for m in MARGINS)))
        joined = join_by_size(rows, every.select(F.col("cell").alias(cell), F.col("p").alias(own[3]), F.col("docs").alias(size)), cell, size)
    probability = F.coalesce(F.col(own[3]), F.lit(0.0))
    struct = F.struct(margin["topic"].alias("topic"), probability.alias("probability"), (drawn(column(key), mix.seed) < probability).alias("kept"), F.lit(met).alias("met"))
    return joined.select(*map(column, names), struct.alias(out))
