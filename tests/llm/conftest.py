import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, m_size string, key string"


@pytest.fixture(scope="session")
def make(spark):
    """documents with extra columns whose names an operator might use itself."""

    def rows(texts, sources=None, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = [f"s{k % 3}" for k in range(len(texts))] if sources is None else sources
        return spark.createDataFrame([(i, t, None, s, None, "x", "y") for i, t, s in zip(ids, texts, sources)], SCHEMA)

    return rows


@pytest.fixture(scope="session")
def prose():
    """Seeded texts with copies, near copies, repeated lines, long and odd ones."""
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line = make(24)
    passage = make(60)
    texts = []
    for k in range(60):
        own = [make(rng.randint(1, 40)) for _ in range(rng.randint(1, 5))]
        if k % 7 == 0:
            own.insert(0, line)
        if k % 9 == 0:
            own[-1] += " " + passage + " " + make(5)
        texts.append("\n".join(own))
    near = texts[3].split(" ")
    near[len(near) // 2] = "zzz"
    texts += [texts[0], texts[0], texts[5], " ".join(near), "", None, " ", "a", "é\tü\x0bé", make(3000), "A B C", "a b c", "\n\n", "to " * 300]
    return texts
