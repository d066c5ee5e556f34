import random

import pytest

WORDS = "the of and to in that is was for on with as by at from this have or one had not but what all were when we there can an".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "ing", "tion"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): ordinary texts and the odd cases."""
    rng = random.Random(7)
    base = [(i, prose(rng, rng.randrange(3, 120))) for i in range(60)]
    copy = base[3][1]
    shared = prose(rng, 40)
    odd = [
        (100, None), (101, ""), (102, "   \n\t"), (103, copy), (104, copy), (105, copy + " end"), (106, "x"), (107, "a b"),
        (108, prose(rng, 20_000)), (109, f"{prose(rng, 30)} {shared} {prose(rng, 30)}"), (110, f"{prose(rng, 9)} {shared}"),
        (111, "ünïcödé wörter überall 文字 \U0001f600 und mehr"), (112, "0"), (113, "same same same same same same same same same same same same same same same same"),
        (None, copy), (None, "no id here"), (114, "repeated row"), (114, "repeated row"), (115, "one id"), (115, "one id, another text"),
    ]
    return base + odd


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With further columns whose names operators use themselves."""
    more = [(i, t, "en" if k % 3 else None, "s", None if t is None else len(t), "x", 1.0, "y") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(more, "doc_id bigint, text string, lang string, source string, n_chars bigint, blob string, score double, spans string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
