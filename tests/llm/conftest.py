import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines int, id int"


def make(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 7, 8) for i, t, lang, s in rows], SCHEMA)


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null in each column, empty, blank and long texts, ties and repeated rows."""
    r = random.Random(1)
    base = words(r, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), None, "a"), (4, None, "en", None), (5, "", None, "b"), (6, " \n\t ", "de", "c"),
        (7, "x", "de", "c"), (8, words(r, 30_000), "en", "a"), (9, "\n".join([words(r, 9), "shared line", words(r, 9)]), "de", "d"), (9, "\n".join(["q", "shared line"]), "de", "d"),
        (10, words(r, 200), "de", "e"), (10, words(r, 200), "de", "e"), (11, "shared line\nü\U0001F600 ÀB", "en", "f"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, [*odd_rows, odd_rows[0]]).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter(F.lit(False))
