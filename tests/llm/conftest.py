import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long"


def made_texts(seed: int, n: int) -> list:
    """(doc_id, text, lang, source, n_chars, size): nulls, empties, copies, near copies, a long text, odd bytes."""
    rng = random.Random(seed)
    words = ["alpha", "Beta,", "gamma.", "déjà", "naïve", "über", "x", "of", "the", "straße", "日本語", "42", "a b", "it's", "!!", "zebra"]
    text = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", "q", "zz", "ing"]) for _ in range(k))
    passage = text(70)
    texts = [None, "", " \n\t ", "one", "one two three", text(3000)]
    while len(texts) < n:
        kind = rng.randrange(5)
        if kind == 0 and len(texts) > 8:
            texts.append(rng.choice(texts))
        elif kind == 1 and len(texts) > 8:
            old = (rng.choice(texts) or "a b c").split(" ")
            old[rng.randrange(len(old))] = "edited"
            texts.append(" ".join(old))
        elif kind == 2:
            texts.append(text(rng.randrange(1, 60)) + " " + passage + " " + text(rng.randrange(1, 60)))
        else:
            texts.append(text(rng.randrange(1, 200)) + rng.choice(["", "\n", " "]))
    return [(i * 3 - 5, t, "en", rng.choice(["a", "b", "hot", "hot", None, ""]), len(t or ""), 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return made_texts(1, 90)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
