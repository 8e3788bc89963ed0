import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, N_LINES string, part string, node string, score string, ids string, count string"


def make_docs():
    """Nulls, blanks, ties, repeated rows, copies, near copies, shared lines and passages, and very long texts."""
    pick = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "mi", "Ta", "re", "éu") for b in ("lo", "n", "sta", "ri", "ß")]
    say = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    shared, passage, base = say(8), say(60), say(70)
    near = base.split()
    near[30] = "changed"
    docs = [
        (1, ""), (2, None), (3, " \t\n \x0b "), (4, "word"), (5, "WORD"), (6, "two words"), (7, f"{base}"), (8, f"{base}"),
        (9, " ".join(near)), (9, " ".join(near)), (10, f"{say(30)}\n{shared}\n{say(9)}"), (11, f"{shared.upper()}  \n{say(40)}"),
        (12, f"{say(20)} {passage} {say(15)}"), (13, f"{say(3)} {passage} {say(25)}\n{shared}"), (13, f"other text {say(12)}"),
        (14, f"{say(15000)} {passage}"), (15, "ab" * 900), (16, "ab" * 300), (17, "a\x00b \x1c c\x85d e " * 30),
        (None, f"{passage} {say(4)}"), (None, base), (18, "!!! ### SHOUT $$$ " * 12), (19, f"{say(11)}\n" * 4), (20, "日本語 " * 120),
    ]
    docs += [(100 + k, " ".join(w for i, w in enumerate(base.split()) if i != k)) for k in range(12)]
    return docs


@pytest.fixture(scope="session")
def docs():
    return make_docs()


@pytest.fixture(scope="session")
def table(spark, docs):
    rows = [(d, t, "en", "s", len(t) if t is not None else None, "x", "x", "x", "x", "x", "x", "x") for d, t in docs]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
