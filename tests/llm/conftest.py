import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = "an th er on in re ed nd ha es to or ti st en".split()
COMMON = "the of and to in is that it for with".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    word = lambda: rnd.choice(COMMON) if rnd.random() < 0.4 else "".join(rnd.choices(SYLLABLES, k=rnd.randint(2, 4)))
    return " ".join(word() for _ in range(n)) + "."


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and odd texts, repeats, ties, a long text, names that clash with result columns."""
    texts = [None, "", " \n\t ", "a", "one two", "A  b  c\n\n d  ", "<|endoftext|> x", "日本 語🙂 ▁ ▁x", "\x00 \x1c",
             prose(1, 80), prose(1, 80), prose(1, 80), prose(2, 120), prose(3, 60), "x" * 5000, prose(4, 6000),
             "line one here\nline one here\nline one here\n" * 30]
    return [(None if i == 5 else 9 if i in (9, 10) else i, t, None if i % 4 == 0 else "en", None, i)
            for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, score int"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows, with extra columns named like the operators' own."""
    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("quality", "language", "ids", "decoded", "row", "gone_id", "nth")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
