import random

import pytest

WORDS = "the of and to a in is that it for was on with as be by this are at from er th an nd re he ed en ha es or ea ti nt ing".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    while n > 0:
        k = min(n, rng.randint(3, 12))
        words = [rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choice(WORDS) for _ in range(3)) for _ in range(k)]
        out.append(" ".join(words).capitalize() + rng.choice([".", ".\n", ",", "!"]))
        n -= k
    return " ".join(out)


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, copies and near copies."""
    rng = random.Random(11)
    rows = []
    for i in range(160):
        rows.append((i, prose(rng, rng.choice([1, 3, 5, 20, 60, 150])), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "a", "b", None])))
    for i in range(160, 190):  # a chain of near copies of one text
        words = rows[-1][1].split(" ") if i > 160 else prose(rng, 120).split(" ")
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words), "en", "hot"))
    rows += [(i, rows[5][1], "en", "hot") for i in range(190, 210)]
    rows += [(300, None, None, None), (301, "", "en", "a"), (302, "  \n\t ", "en", "a"), (None, "null id here", "en", "a"), (303, prose(rng, 4000), "en", "b"), (304, "É́ İ. <|endoftext|> x   y \n\n z  ", "fr", "b"), (305, "one two", "en", "a"), (306, "One  TWO", "en", "a")]
    return [*rows, rows[7], rows[7]]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame(rows, schema).repartition(5).selectExpr("*", "lang as n_words", "source as shard", "'x' as ids")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.filter("false")
