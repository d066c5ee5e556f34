"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

from sparkweave.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    others = {w: [x for x in n if x != w and near(w, x)] for w in n}
    form = {}
    for w, near_ones in others.items():
        best = min(near_ones, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_same_as_brute_force(spark, docs, rows, empty):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéÿ×Z") for _ in range(rng.randrange(6, 11))) for _ in range(25)]
    many = list(rows)
    for i in range(300, 420):
        words = []
        for _ in range(60):
            w = stems[min(rng.randrange(25), rng.randrange(25))]
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] * 2, "è"]) + w[at + 1 :]
            words.append(w)
        many.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    many.append((500, "variant" + "a" * 100_000 + " " + "variant" + "a" * 100_000))
    many.append((501, "variant" + "a" * 100_001 + " " + "variant" + "a" * 100_001))
    got = spelling.spelling_variants(spark.createDataFrame(many, "doc_id bigint, text string").repartition(5))
    want = expected(many)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(r[1] and r[2] != r[1] for r in want) or any(r[1] for r in want)
    assert spelling.spelling_variants(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_variants(empty).count() == 0


def test_chains_of_forms_end_at_the_last(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(6)] + [("alone", None), ("w6", None)], "word string, form string")
    from sparkweave.operators.scratch import Scratch

    roots = {r["word"]: r["root"] for r in spelling.roots_of(forms, Scratch(spark)).collect()}
    assert roots == {f"w{i}": "w6" for i in range(6)}


def test_a_crowd_under_one_half_loses_no_pair(spark):
    words = [f"prefixed{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcd"]
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    got = {(r["a"], r["b"]) for r in spelling.near_words(table).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)}
