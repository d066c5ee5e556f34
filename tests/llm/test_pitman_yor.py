"""Language-model scores: the base against brute force, the model against a plain sampler and as a distribution."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkweave.llm import pitman_yor as py


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base_of(rows):
    c = Counter(t for i, text in rows if not is_held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(i, is_held(i), len(w := tokens(text)), sum(c[t] > 0 for t in w), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w)) for i, text in rows]


def order(r):
    return (r[0] is None, r[0] or 0, r[2], round(r[5], 6))


def same_base(got, rows):
    want = base_of(rows)
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)


def chain_text(rng, n):
    """Each word prefers a few followers."""
    out, w = [], 0
    for _ in range(n):
        w = (w * 7 + rng.choice([1, 1, 2, 3])) % 40 if rng.random() < 0.8 else int(40 * rng.random() ** 2)
        out.append(f"w{w}")
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    return [(i, chain_text(rng, rng.randrange(1, 80))) for i in range(160)]


def test_base_is_exact_whatever_the_layout(spark, docs, rows, empty):
    same_base(py.language_model_scores(docs).collect(), rows)
    small = py.Plan(bucket_bytes=50_000, chunk_tokens=500, hot_share=8, rounds=0, burn_in=1, samples=1)
    got = py.language_model_scores(docs, plan=small)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    same_base(got, rows)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert py.language_model_scores(empty).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if is_held(i))
    row = py.language_model_scores(spark.createDataFrame([(held, "some text")], "doc_id bigint, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)


def plain_sampler(texts, sweeps, strength, seed):
    """Every customer in turn, with lists of table sizes; gives the mean predictive probability of (context, word)."""
    rng = random.Random(seed)
    pairs = [(u, w) for t in texts for u, w in zip(["<s>", *t], t)]
    counts = Counter(pairs)
    v = len({w for _, w in pairs})
    est = lambda values: py.discount_of(sum(x == 1 for x in values), sum(x == 2 for x in values))
    d1, d0 = est(counts.values()), est(Counter(w for _, w in counts).values())
    seats, top = defaultdict(list), defaultdict(list)
    total, tables, sums = Counter(), Counter(), [0, 0]

    def parent(w):
        return (sum(top[w]) - d0 * len(top[w]) + (strength + d0 * sums[1]) / (v + 1)) / (strength + sums[0])

    def sit(rooms, key, weight, d):
        sizes = rooms[key]
        x = rng.random() * (weight + sum(sizes) - d * len(sizes))
        for k, s in enumerate(sizes):
            x -= s - d
            if x < 0:
                sizes[k] += 1
                return False
        sizes.append(1)
        return True

    def leave(rooms, key):
        sizes = rooms[key]
        k = rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    def enter(u, w):
        new = sit(seats, (u, w), (strength + d1 * tables[u]) * parent(w), d1)
        total[u] += 1
        if new:
            tables[u] += 1
            sums[1] += sit(top, w, (strength + d0 * sums[1]) / (v + 1), d0)
            sums[0] += 1

    for p in pairs:
        enter(*p)
    kept = []
    for sweep in range(sweeps):
        for u, w in pairs:
            total[u] -= 1
            if leave(seats, (u, w)):
                tables[u] -= 1
                sums[1] -= leave(top, w)
                sums[0] -= 1
            enter(u, w)
        if sweep >= sweeps // 2:
            kept.append(({k: (sum(s), len(s)) for k, s in seats.items()}, dict(total), dict(tables), {w: parent(w) for w in top}, (strength + d0 * sums[1]) / (v + 1) / (strength + sums[0])))

    def p(u, w):
        out = 0
        for pair, n, t, above, unknown in kept:
            c, k = pair.get((u, w), (0, 0))
            out += (c - d1 * k + (strength + d1 * t.get(u, 0)) * above.get(w, unknown)) / (strength + n.get(u, 0)) / len(kept)
        return out

    return p


def test_close_to_a_plain_sampler(spark, corpus):
    model = plain_sampler([tokens(t) for i, t in corpus if not is_held(i)], 12, 1.0, 1)
    got = {r["doc_id"]: r for r in py.language_model_scores(spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3), plan=py.Plan(burn_in=40, samples=20)).collect()}
    for held in (False, True):
        mine = plain = base = n = 0
        for i, text in corpus:
            if is_held(i) == held:
                w = tokens(text)
                plain += sum(math.log10(model(a, b)) for a, b in zip(["<s>", *w], w))
                mine, base, n = mine + got[i]["score"], base + got[i]["base_score"], n + len(w)
        assert abs(mine - plain) / n < 0.01
        assert (mine - base) / n > 0.1


def test_hot_contexts_by_classes_score_about_the_same(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    assert len(py.hot_contexts(docs.withColumn("held_out", F.lit(False)), 64)) > 5
    one = py.language_model_scores(docs).groupBy("held_out").sum("score", "n_tokens").collect()
    two = py.language_model_scores(docs, plan=py.Plan(hot_share=64, bucket_bytes=1000)).groupBy("held_out").sum("score", "n_tokens").collect()
    for a, b in zip(sorted(one), sorted(two), strict=True):
        assert abs(a[1] - b[1]) / a[2] < 0.1


def test_scores_do_not_depend_on_the_layout(spark, corpus):
    """Contexts dealt by classes or whole, in one bucket or several; words that are not trained on follow contexts that are dealt."""
    more = [(i, f"{text} new{i} {text}" if is_held(i) else text) for i, text in corpus]
    docs = spark.createDataFrame(more, "doc_id bigint, text string").repartition(3)
    size = sum(len(text) + 1 for _, text in more)
    assert len(py.hot_contexts(docs, 4 * size / 2000)) > 5
    runs = []
    for plan in (py.Plan(), py.Plan(bucket_bytes=2000, hot_share=1), py.Plan(bucket_bytes=2000, chunk_tokens=700)):
        runs.append({r["doc_id"]: r["score"] for r in py.language_model_scores(docs, plan=plan).collect()})
    assert len(runs[0]) == len(more)
    for other in runs[1:]:
        assert other == pytest.approx(runs[0], rel=1e-9, abs=1e-9)


def test_probabilities_add_up_to_one(spark, corpus):
    """Over all known words and the unknown one, in every context, dealt by classes or not."""
    plan = py.Plan(bucket_bytes=1 << 30, samples=3)
    texts = [t for _, t in corpus]
    ids, sizes = py.tokens_of(texts)
    contexts = py.contexts_of(ids, sizes)
    vocabulary, hot = np.unique(ids), np.sort(np.unique(contexts)[[3, 9]])
    # a last document, not trained on, holds every word after every context, and no other pair
    asked = [(u, w) for u in np.unique(contexts) for w in vocabulary]
    more_u, more_w = (np.array(x, np.uint64) for x in zip(*asked))
    doc = np.concatenate([np.repeat(np.arange(len(texts)), sizes), np.full(len(asked), len(texts))])
    train = np.arange(len(texts) + 1) < len(texts)
    (key, packed), = py.packets_of(np.concatenate([ids, more_w]), np.concatenate([contexts, more_u]), doc, train, hot, 1)
    row = pa.table({"chunk": [0], **{p: [b] for p, b in zip(py.PARTS, packed, strict=True)}})
    bucket = py.Bucket(row)
    from sparkweave.operators.scratch import Scratch

    scratch = Scratch(spark)
    model = py.Model(spark.createDataFrame([], "bucket int"), 3, hot, plan, scratch)
    stats = py.word_stats(0, bucket, np.minimum(bucket.count, 1), 3, model.hot_rooms)
    parent, answers = model.parent(spark.createDataFrame(stats.to_pandas(), py.STATS))
    base = np.zeros(len(bucket.words))
    for r in answers.collect():
        base[py.word_part(bucket.words, 3) == r["part"]] = np.frombuffer(r["base"])
    assert base.sum() + parent.unknown == pytest.approx(1)
    assert parent.class_mass.sum() == pytest.approx(1)
    p, chance = parent.of_pairs(bucket, base)
    tables, by_room, _ = py.sample_tables(bucket.count, bucket.room, len(bucket.rooms), p, 1.0, parent.discount, plan, 0)
    inside = bucket.count - parent.discount * tables + (1 + parent.discount * by_room[bucket.room]) * p
    whole = np.bincount(bucket.room, inside / (1 + bucket.room_counts()[bucket.room]) * chance[bucket.room], len(bucket.rooms))
    is_hot = np.isin(bucket.rooms, model.hot_rooms)
    rest = (1 + parent.discount * by_room) / (1 + bucket.room_counts()) * parent.unknown
    assert np.allclose(whole[~is_hot] + rest[~is_hot], 1)
    at = np.searchsorted(model.hot_rooms, bucket.rooms[is_hot])
    classes = model.hot_class[at]
    inner = (1 + parent.discount * by_room[is_hot]) / (1 + bucket.room_counts()[is_hot]) * parent.unknown / py.CLASSES / parent.class_mass[classes] * chance[is_hot]
    assert np.allclose(whole[is_hot] + inner, chance[is_hot])
    known = np.bincount(model.hot_context, parent.hot_chance)
    assert np.allclose(known, 1)


def test_packing_of_numbers():
    for a in ([], [0], [255], [256, 1], [1 << 40], [(1 << 64) - 1]):
        assert py.unpack(py.pack(np.array(a, np.uint64))).tolist() == a


def counted(c, discount):
    """Logarithms of the ways to seat c customers at 1 to c tables."""
    return dict(py.seatings(c, discount))[c]


def test_ways_to_seat_customers():
    # 4 customers: one table; 1 + 3 or 2 + 2; 1 + 1 + 2; each alone
    d = 0.3
    want = [(1 - d) * (2 - d) * (3 - d), 4 * (1 - d) * (2 - d) + 3 * (1 - d) ** 2, 6 * (1 - d), 1]
    assert np.allclose(np.exp(counted(4, d)), want)
    for d in (0.1, 0.5, 0.95):
        t = np.arange(1, 1101)
        factorials = np.cumsum(np.log(t))
        assert np.allclose(py.log_parts(1100, t, d), counted(1100, d) + factorials + t * math.log(d) - factorials[-1], atol=1e-6, rtol=0)


@pytest.mark.parametrize("customers", [40, 300, 1500])
def test_a_step_seats_all_customers(customers):
    """The numbers of tables are as likely as the ways to have them, however many customers a pair has."""
    n, weight, d = 3000, 4.0, 0.6
    t = np.arange(1, customers + 1)
    logs = counted(customers, d) + t * math.log(weight)
    chance = np.exp(logs - logs.max())
    chance /= chance.sum()
    mean = (chance * t).sum()
    spread = (chance * (t - mean) ** 2).sum()
    _, _, last = py.sample_tables(np.full(n, customers), np.arange(n), n, np.full(n, weight), 1.0, d, py.Plan(), 5, np.ones(n))
    assert abs(last.mean() - mean) < 5 * (spread / n) ** 0.5
    assert 0.85 < last.var() / spread < 1.15
