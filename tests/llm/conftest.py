import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g int, size long, component string"


def texts(seed: int = 3) -> list[tuple]:
    """Small documents with every awkward case: nulls, empty and blank texts, copies, near copies, shared passages, repeats, one long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, rows = make(40), []
    base = make(120)
    for i in range(60):
        words = make(r.choice([3, 20, 60, 150]))
        if i % 4 == 0:
            words[1:1] = passage[: r.randint(13, 40)]
        if i % 5 == 0:
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        text = "".join(w + r.choice([" ", " ", "  ", "\n", ". ", "\t"]) for w in words)
        rows.append((i, text, r.choice(["en", "fr"]), r.choice(["s1", "s2", "s2", None]), len(text)))
    copy = rows[7][1]
    rows += [(100 + i, copy, "en", "s1", 1) for i in range(5)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \n\t ", "en", "s3", 4), (203, "One", "en", "s1", 3), (204, "one", "en", "s1", 3), (205, "ab " * 3000, "en", "s2", 9000)]
    rows += [(None, copy, "en", "s1", 1), (None, None, None, None, None), (3, rows[3][1], "en", "s1", 1), (3, rows[3][1], "en", "s1", 1), (4, "a text of its own under a used id", "fr", "s9", 1)]
    return [(*row, 7, 9, "x") for row in rows]


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
