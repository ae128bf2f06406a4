import datetime

import pytest

#: Columns that share names with the operators' own.
CLASHING = {"chunk": "int", "id": "string", "tag": "string", "row": "string", "body": "string", "bucket": "long", "size": "long", "place": "long", "turn": "int", "part": "string", "kept": "boolean", "score": "double", "ids": "array<int>", "at": "timestamp"}

PASSAGE = " ".join(f"passage{i} word{i * 7 % 13}" for i in range(40))
STORY = " ".join(f"story{i * i % 97} of{i % 11} day{i}" for i in range(120))


def rows():
    near = STORY.replace("day7 ", "day7x ").replace("day90", "day90y")
    texts = [
        (1, STORY), (2, None), (3, ""), (4, " \t\n "), (5, STORY), (6, near), (7, f"Start here {PASSAGE} and then on."),
        (8, f"Something else first. {PASSAGE} The end of it is other."), (9, "one two three"), (10, "é😀漢字 — don't 123's"), (None, f"Null id {PASSAGE} tail"),
        (11, "same line\n" * 30), (12, "### $$$ %%% a# b$ c% " * 10), (13, "x" * 5000), (14, STORY), (14, STORY), (15, "\x0b\x0cword\rother"), (16, "tiny"),
        (17, " ".join(f"long{i}" for i in range(6000))), (18, "aaaa " * 400), (19, f"{PASSAGE} {PASSAGE}"), (20, "ein zwei drei " * 3 + STORY),
    ]
    now = datetime.datetime(2024, 1, 1)
    sources = [None, "a", "b", "a", "a", "c", "é"]
    return [(i, t, None if k % 5 == 0 else "en", sources[k % len(sources)], len(t or ""), k, "id", None, "row", "b", k, k, k, k, "p", None, 0.5, [1], now) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {t}" for c, t in CLASHING.items())
    return spark.createDataFrame(rows(), schema).repartition(3)


@pytest.fixture(scope="session")
def plain_docs():
    return [r[:4] for r in rows()]


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
