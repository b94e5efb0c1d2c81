"""Small documents with the odd cases that all operators take."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, t string"


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "li") for b in ("n", "st", "k") for c in ("a", "er", "ing", "o")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randrange(5, 90))) for i in range(60)]
    base = text(80).split()
    for i in range(60, 75):  # near copies
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(80, rows[3][1]), (81, rows[3][1].upper()), (82, None), (83, ""), (84, " \n\t "), (85, "One two"), (86, "one TWO"), (87, rows[4][1]), (87, rows[4][1])]
    rows += [(None, rows[5][1]), (90, text(6000)), (91, "naïve Ünïcode 漢字 🙂 !!! $$$"), (92, "a\na\nb\n\na\n" + "w x y z q " * 12)]
    return [(i, t, "en", None if i in (7, 82) else f"s{(i or 0) % 4}", len(t or ""), "clash", "clash") for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
