"""Many globs at once against one regular expression for each rule."""

import random
import time

import pytest
from pyspark.sql import functions as F

from driftline.functions import globs, rules

PATTERNS = [
    "a/b.txt", "b.txt", "*.log", "**/*.tmp", "src/", "src/*", "lib*", "*/x", "**/*x", "**/y/z.bin", "?.md", "d/*/e", "*.{jpg,png}", "[ab]c", "**", "*", "*/**", "**/**/q",
    "é*", "*ß", "a\\b", "***.cc", "**/*/r", "k/**/m", "**/", "n/**/", "*/", "x**", "**x/y", "*/*",
]


def paths() -> list[str]:
    rng = random.Random(3)
    names = ["a", "b", "b.txt", "x", "ax", "y", "z.bin", "q", "r", "m", "k", "d", "e", "ac", "src", "lib", "libx", "n", "n.md", "c.md", "o.log", "o.tmp", "p.jpg", "p.png", "été", "groß", "i.cc", "t\nu"]
    return sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(600)} | {"", "/", "/x", "x/", "lib", "*", "q"})


@pytest.mark.parametrize("pattern", PATTERNS)
def test_a_rule_matches_what_its_expression_matches(spark, pattern):
    df = spark.createDataFrame([(p,) for p in paths()], "p string")
    one = F.rlike("p", F.lit(globs.regex(globs.normalized(pattern))))
    many = rules.first_rule(F.col("p"), [pattern])
    assert df.filter(one != F.coalesce(many == 0, F.lit(False))).collect() == []


def test_first_of_many(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(p,) for p in paths()], "p string")
    for _ in range(5):
        order = rng.sample(PATTERNS, len(PATTERNS))
        want = F.coalesce(*(F.when(F.rlike("p", F.lit(globs.regex(globs.normalized(g)))), i) for i, g in enumerate(order)), F.lit(-1))
        assert df.filter(want != F.coalesce(rules.first_rule(F.col("p"), order), F.lit(-1))).collect() == []
        include, exclude = order[:3], order[3:9]
        assert df.filter(rules.allows(F.col("p"), include, exclude) != globs.allows(F.col("p"), include, exclude)).collect() == []


def test_defined_cases(spark):
    df = spark.createDataFrame([(None,), ("a",)], "p string")
    pick = lambda c: [r[0] for r in df.select(c).collect()]
    assert pick(rules.first_rule(F.col("p"), [])) == [None, None]
    assert pick(rules.first_rule(F.col("p"), ["a", "a", "*"])) == [None, 0]
    assert pick(rules.allows(F.col("p"))) == [True, True] and pick(rules.allows(F.col("p"), ["b"])) == [False, False]
    with pytest.raises(ValueError):
        rules.first_rule(F.col("p"), ["a", " "])


def test_ten_thousand_rules_cost_about_as_much_as_ten(spark):
    df = spark.range(200_000).select(F.concat(F.lit("root/"), F.col("id") % 997, F.lit("/file"), F.col("id"), F.lit(".dat")).alias("p")).repartition(4).cache()
    assert df.count() == 200_000

    def seconds(n):
        listed = [f"root/{i}/file{i}.dat" if i % 3 else f"*le{i:05}.dat" for i in range(n)]
        column = rules.first_rule(F.col("p"), listed)
        best = []
        for _ in range(3):
            began = time.time()
            df.select(F.count(column)).collect()
            best.append(time.time() - began)
        return min(best)

    few, many = seconds(10), seconds(10_000)
    assert many < 5 * few + 2, (few, many)
