import random

import pytest

AWKWARD = "doc_id long, text string, source string, fp long, gone array<string>, digest string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Small documents with copies, near copies, nulls, empty and long texts, repeated rows and clashing columns."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    texts = [prose(rng.randint(1, 300)) for _ in range(60)]
    texts += [texts[3], texts[3].upper(), texts[3], texts[5] + "  ", texts[7].replace(" ", " \n"), None, "", " \t", None, "one", "One two"]
    texts += [t[:-1] + rng.choice("!?") for t in texts[20:40]] + [prose(30_000)]
    rows = [(i, t, "s", 1, None, "d") for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[3], None, None, [], None), (None, None, "x", 0, ["a"], ""), (200, "short", None, None, None, None)]
    return spark.createDataFrame(rows, AWKWARD), [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], AWKWARD)
