import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Small documents with copies, near copies, nulls, empties and a long text."""
    rnd = random.Random(5)
    words = ["the", "and", "ther", "ation", "ment", "erin", "ould", "ver", "ness", "Ich", "eau", "cion", "über", "ña", "x1", "42"]
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", ".", ",", "\n"]) for _ in range(rnd.randint(1, 90))) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", texts[2].upper(), "", None, " \n\t ", "one", "two words", "é", "🙂 🙂", "a\tb\x0bc d", " ".join(words * 4000)]
    rows = [(3 * i + 1, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, texts[3], None, None, None)], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
