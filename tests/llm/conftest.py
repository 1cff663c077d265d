import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, key string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def made(spark):
    """Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        rows.append((i, words(rng, rng.randrange(1, 120)), "en", f"s{i % 4}"))
    base = words(rng, 200)
    rows += [(100 + i, base, "en", "s0") for i in range(8)]
    near = base.split()
    for i in range(8):
        other = list(near)
        other[rng.randrange(200)] = "changed"
        rows.append((120 + i, " ".join(other), "en", "s1"))
    rows += [(200, None, None, None), (201, "", "en", None), (202, " \t\n ", "de", "s2"), (203, words(rng, 20_000, 9_000), "en", "s0"), (204, "one", "en", "s3")]
    rows += [(205, "Äé ẞ ünï " * 30, "de", "s3"), (206, "a b " * 200, "en", "s3"), (None, "no id at all", "en", "s0"), (7, "same id other text", "en", "s1")]
    rows += [rows[3], rows[3], rows[60]]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(made):
    return made.limit(0)
