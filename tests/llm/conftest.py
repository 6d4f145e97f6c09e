"""Small documents with every awkward case: nulls, empty and long texts, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, block int, kept boolean"


def awkward_rows(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "épée", "日本", "x", "the", "of", "1.2.3.4", "a@b.co", "|", "end."]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 120))) for _ in range(24)]
    passage = " ".join(f"w{i}" for i in range(60))
    texts += [None, "", " \n\t ", "short", "one two three", texts[0], texts[0], texts[3] + " tail", "head " + texts[3]]
    texts += [passage, "x " + passage + " y", passage.upper(), "a" * 3000, "ab " * 900, "line one\nline one\n\nline 1\nlime one\nline onee\n"]
    texts += [("long " + " ".join(r.choice(words) for _ in range(9000))), "+1 (017) 555-7713 and 0445617099674829 at 999.1.1.1 token = \"2b0cb261201f091f\""]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, texts[5]), (None, None), (4, texts[1]), (1, texts[0])]
    r.shuffle(rows)
    return [(i, t, "en", r.choice(["s1", "s2", "s3", None]), len(t or ""), 7, 3, None) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
