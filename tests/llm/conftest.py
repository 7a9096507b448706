import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, score string, size string"


def frame(spark, texts, langs=None, sources=None, parts=3):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, (langs or {}).get(i, "en"), sources[i] if sources else f"src{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, **more: frame(spark, texts, **more)


def prose(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("th", "er", "on", "st", "re", "li", "ma") for b in ("a", "e", "i", "o") for c in ("nd", "ing", "tion", "ly", "s", "", "ble", "mo", "rta", "q", "w", "z", "u", "k")][:vocabulary]
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def text_of():
    return prose


@pytest.fixture(scope="session")
def awkward():
    """Null, empty and blank texts, ties, repeats and a long text."""
    return [None, "", " \n\t ", "one", "one", "Two words", "two WORDS", "éè \U0001f600 x", prose(9, 30_000), "9" * 50_000, "a b\n" * 3000]
