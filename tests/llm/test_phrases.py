"""Collocations against brute force with Python's whole numbers."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkweave.llm import phrases
from sparkweave.operators.scratch import Scratch


def expected(rows, least, most):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    good = {p: c for p, c in f.items() if c >= least}
    held = set()
    for (lang, p), c in good.items():
        for k in range(2, len(p)):
            held.update((lang, p[i : i + k]) for i in range(len(p) - k + 1) if 100 * c >= 100 * good[lang, p[i : i + k]])
    out = []
    for lang in n:
        rows = []
        for (own, p), a in good.items():
            if own == lang and len(p) >= 2 and (own, p) not in held:
                score, k = min((1000 * a * n[lang] // (good[lang, p[:k]] * good[lang, p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), good[lang, p[:k]], good[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["the", "of", "Of", "a", "né", "x1", "\x00", "文字", "tail"]
    rows = []
    for i in range(250):
        text = ""
        for _ in range(rng.randrange(0, 30)):
            text += rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " "])
        rows.append((rng.choice(["en", "de", None, "und"]), text + rng.choice(["", "so it is said, so it is said", "a a a a a a a"])))
    return [*rows, (None, None), ("fr", ""), ("fr", " .,;"), ("en", "word " * 20_000), ("en", "w" * 1_000_000)]


@pytest.mark.parametrize("task_pointers", [1_000_000, 40, 1])
def test_same_as_brute_force(spark, corpus, task_pointers):
    docs = spark.createDataFrame([(i, lang, text, "x") for i, (lang, text) in enumerate(corpus)], "doc_id int, lang string, text string, word string").repartition(5)
    for least, most in ((6, 2000), (20, 3)):
        got = phrases.collocations(docs, least, most, task_pointers)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == expected(corpus, least, most)
        if task_pointers > 1:
            break


def test_empty_table(spark, docs, empty):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(docs, least=50).where("a < 50").count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    a, left, right, n = 3_000_000_007, 4_000_000_009, 5_000_000_011, 900_000_000_000_000_003
    every = spark.createDataFrame([([1], left), ([2], right), ([1, 2], a)], phrases.PHRASES)
    words = spark.createDataFrame([(1, "en", "u", left), (2, "en", "v", right), (3, "en", "w", n - left - right)], "id bigint, lang string, word string, n bigint")
    row = phrases.scored(every.where("size(ids) = 2"), every, words).first()
    assert (row["n"], row["score"]) == (n, 1000 * a * n // (left * right))


def test_a_shared_hash_leads_to_another_seed(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "one two one two")] * 5, "lang string, text string")
    plain, seeds = phrases.words_of, []

    def clashing(docs, seed):
        seeds.append(seed)
        words = plain(docs, seed)
        return words.withColumn("id", words["id"] * 0 + 7) if seed == 0 else words

    monkeypatch.setattr(phrases, "words_of", clashing)
    _, every = phrases.frequent_phrases(docs, Scratch(spark), least=5)
    assert seeds == [0, 1] and every.count() == 2 + 2 + 2 + 1


def test_filter_never_loses_a_key(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    bits = phrases.member_bits(spark.createDataFrame([(int(k),) for k in keys], "key bigint"))
    assert phrases.is_member(bits, keys.view(np.uint64)).all()
