import random

import pytest

LONG = "lorem ipsum dolor sit amet " * 20000


def awkward_rows():
    """Nulls, empty and very long texts, ties and repeated rows; with a clashing extra column."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 0),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 0),
        (2, "the quick brown fox jumps over the lazy dog", "en", None, 1),
        (3, "", "en", "a", 2),
        (4, None, None, "b", 3),
        (None, None, None, None, 4),
        (None, "a text without any id at all", "en", "a", 5),
        (5, LONG, "en", "b", 6),
        (6, "   \t\n ", "en", "b", 7),
        (7, "12345 67890 !!!", None, "b", 8),
        (8, "été où ça naïve façade 日本語", "fr", "a", 9),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, mark long"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """A generator of sentences from a made-up vocabulary."""
    random.seed(5)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 7))) for _ in range(400)]

    def make(words, seed):
        draw = random.Random(seed)
        return " ".join(draw.choice(vocabulary) for _ in range(words))

    return make
