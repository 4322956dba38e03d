import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Made-up documents with copies, near copies, nulls, empty and long texts, and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(60):
        t = text(rng.choice([1, 3, 5, 30, 120]))
        rows.append((i, t, "en" if i % 2 else "de", ["a", "b", "c", None][i % 4]))
    base = text(200).split()
    for i in range(60, 80):  # near copies of one text
        w = base[:]
        for _ in range(i % 5):
            w[rng.randrange(200)] = "edit" + str(rng.randrange(99))
        rows.append((i, " ".join(w), "en", "b"))
    rows += [(90 + i, base_text, None, "é") for i, base_text in enumerate(["A b C d", "a b c d", "same Words here please now ok", "same words here please now OK"])]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \n\t ", "en", "a"), (103, "12 34", None, "a"), (104, text(20000), "de", "c"), (105, rows[5][1], "en", "c"), (105, rows[5][1], "en", "c")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
