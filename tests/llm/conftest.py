import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone cloud paper green quiet window garden silver orange market wonder simple летo naïve élan über 漢字".split()


def make_text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: copies, edited copies, shared passages, nulls, blanks, one long text."""
    rng = random.Random(7)
    texts = [make_text(rng, rng.randint(1, 120)) for _ in range(60)]
    base = make_text(rng, 150).split(" ")
    for edits in (0, 0, 2, 4, 6, 8, 10, 14, 20, 30):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = make_text(rng, 1)
        texts.append(" ".join(words))
    passage = make_text(rng, 60)
    texts += [make_text(rng, 20) + "\n" + passage + "\n" + make_text(rng, 20) for _ in range(6)]
    texts += [None, "", " \n\t ", "One", "one", "a b c d", "A  b\tC d", "Released under the MIT License.", "x" * 3000, make_text(rng, 6000)]
    langs = ["en", "fr", None]
    return [(10 * i + 1, t, langs[i % 3], None if i % 11 == 0 else f"src{i % 5 if i % 2 else 0}", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("id", "key", "node", "root", "size", "shard", "score", "copies", "unit", "n", "part", "bands")})


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
