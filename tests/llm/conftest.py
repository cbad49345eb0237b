import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, fp long, shard int, bucket int, id long, label string"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, repeated rows and ids, ties, and columns whose names clash."""
    rng = random.Random(4)
    passage, base = words(rng, 60), words(rng, 120)
    texts = [
        (1, base), (2, base), (3, base + " tail"), (3, base + " tail"), (3, words(rng, 30)), (4, None), (5, ""), (6, "   \n\t "), (7, "x"),
        (8, words(rng, 20) + " " + passage + " " + words(rng, 5)), (9, passage), (10, words(rng, 20_000)), (11, "a" * 30_000), (None, base), (None, "only here"),
        (12, "Mail a.b@c.de, +49 30 123456789, 4539 1488 0343 6467, 10.0.0.255, DE89 3704 0044 0532 0130 00 \U0001f600 10.0.0.256"),
    ]
    rows = [(i, t, None if k % 4 == 0 else "en", [None, "a", "b"][k % 3], None if t is None else len(t), "s", 0.5, 7, 1, 2, 3, "l") for k, (i, t) in enumerate(texts)]
    return rows + [(20 + k, words(rng, 40), "en", "a", 1, None, None, None, None, None, None, None) for k in range(12)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
