import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, doc string, `set` int, key int, src int"


def prose(seed, n):
    import random

    r = random.Random(seed)
    return [f"{r.choice('abcdefgh')}{r.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows; other columns have names that operators use themselves."""
    base = " ".join(prose(1, 300))
    near = " ".join([*prose(1, 300)[:150], "other", *prose(1, 300)[151:]])
    texts = [
        (1, base), (2, base), (3, near), (4, " ".join(prose(2, 300))), (5, None), (6, ""), (7, "  "), (8, " "), (9, "one"),
        (10, "one two"), (10, "one two"), (None, "lost"), (None, "lost"), (None, None), (11, "x " * 3000), (12, "A\tb\nc  d"), (13, "A b c d"),
        (14, "é Ü ß İ 漢字 😀 <|endoftext|> it's 12³"), (15, " ".join(prose(3, 40) + prose(1, 300)[20:80])), (16, " ".join(prose(4, 9000))),
    ]
    return [(i, t, "en", "s", None if t is None else len(t), "r", "d", 1, 2, 3) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(x):
    return None if x is None or x != x else x
