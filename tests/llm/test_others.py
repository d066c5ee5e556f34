"""Quality, decontamination and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.llm import decontaminate, linear, quality, textvec


def test_ordinal_regression_separates_three_grades(spark, empty):
    rng = random.Random(11)
    rows = []
    for i in range(450):
        n = rng.randrange(8, 60)
        words = [rng.choice("ordinary prose about several plain things".split()) + rng.choice(["", "s"]) for _ in range(n)]
        grade = i % 3
        if grade == 0:
            words = [w + rng.choice(["%%%", "***"]) for w in words]
        if grade == 1:
            words[::4] = ["Rude"] * len(words[::4])
        rows.append((i, " ".join(words), grade))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    graded = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 5] + [(3, None), (None, 1), (1, rows[1][2])], "doc_id bigint, grade int")
    odd = docs.union(spark.createDataFrame([(900, None), (901, ""), (None, "plain prose"), (902, "plain things " * 40_000)], docs.schema))
    got = {r["doc_id"]: r for r in quality.rate_quality(odd, graded).collect()}
    assert len(got) == len(rows) + 4
    right = sum((got[i]["expected_grade"] > 1.5) == (g == 2) and got[i]["selected"] == (g > 0) for i, _, g in rows if i % 5 == 0)
    assert right >= 0.95 * len([1 for r in rows if r[0] % 5 == 0])
    assert all(0 <= r["tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.values())
    model = quality.fit_ratings(docs, graded)
    assert (np.diff(model[1]) > 0).all()
    assert quality.rate_quality(empty, graded).count() == 0
    assert quality.select_quality(odd, graded.where("false")).count() == odd.count()
    assert quality.select_quality(odd, graded).columns == odd.columns


def plain_shingles(text, size=5):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.fixture(scope="module")
def benchmark(rows):
    rng = random.Random(21)
    long = dict(rows)[108].split()
    items = [(0, " ".join(long[500:530])), (1, " ".join(long[9000:9040]).upper()), (2, "never there at all in any of the documents here"), (3, None), (4, ""), (5, "x"), (6, "a b"), (7, dict(rows)[109][:220])]
    broken = long[2000:2040]
    broken[20] = "changed"
    items += [(8, " ".join(broken)), (9, " ".join(rng.choice(long) for _ in range(30))), (10, " ".join(long[60:67])), (0, " ".join(long[500:530])), (11, " ".join(long[100:106] + ["other"] + long[200:206]))]
    return items


def test_containment_is_exact(spark, docs, rows, empty, benchmark):
    items = spark.createDataFrame(benchmark, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.contaminated(docs, items)
    want = set()
    for i, t in rows:
        for j, b in set(benchmark):
            s = plain_shingles(b)
            if s and len(s & plain_shingles(t)) >= 0.8 * len(s):
                want.add((i, j, round(len(s & plain_shingles(t)) / len(s), 6)))
    assert {(r["doc_id"], r["item_id"], round(r["containment"], 6)) for r in got.collect()} == want
    assert {j for _, j, _ in want} >= {0, 1, 5, 6, 7, 8, 10}
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    dirty = {(i, t) for i, t in rows if any(i == d for d, _, _ in want)}
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(r for r in rows if r not in dirty)


def test_shuffled_join_gives_the_same(spark, docs, benchmark, monkeypatch):
    items = spark.createDataFrame(benchmark, "item_id bigint, text string")
    want = sorted(map(repr, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", 0)
    assert sorted(map(repr, decontaminate.contaminated(docs, items).collect())) == want


def test_signature_entries_stay_when_bins_get_finer(spark):
    values = sorted(random.Random(1).getrandbits(64) - (1 << 63) for _ in range(200))
    df = spark.createDataFrame([(values,)], "h array<bigint>")
    least = df.select(F.inline(decontaminate.least_bits(F.col("h"))).alias("x", "bits")).collect()
    for bits in (1, 5, 8, 20):
        got = df.select(decontaminate.signature(F.col("h"), F.lit(bits))).first()[0]
        bins = {}
        for v in values:
            bins.setdefault((v % (1 << 64)) >> (64 - bits), v)
        assert sorted(got) == sorted(bins.values()) == sorted(r["x"] for r in least if r["bits"] <= bits)


def test_features_of_groups_equal_those_of_single_texts():
    from sparkweave.llm.toxicity import ngram_features

    texts = ["", "Abc  déf", "abc", "x" * 300, "tail of it"]
    number, feature, _ = ngram_features(texts, None)
    for i, t in enumerate(texts):
        assert feature[number == i].tolist() == ngram_features([t], None)[1].tolist()
    shape = quality.ShapeFeatures()
    number, feature, value = shape(texts, None)
    for i, t in enumerate(texts):
        own = shape([t], None)
        assert feature[number == i].tolist() == own[1].tolist() and np.allclose(value[number == i], own[2])


def test_samples_are_drawn_below_any_share(spark):
    from sparkweave.llm.common import labelled_sample, sampled

    n = 20_000_000
    assert 1 <= spark.range(n).where(sampled(F.col("id"), 12, n)).count() <= 40  # a share below 2 ** -20
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 100 == 0, 1).otherwise(0).alias("toxic"))
    drawn = {r["toxic"]: r["count"] for r in labelled_sample(docs, labels, 300, "toxic").groupBy("toxic").count().collect()}
    assert 200 <= drawn[0] <= 400 and 5 <= drawn[1] <= 30


def test_adam_finds_a_minimum():
    assert np.allclose(linear.adam(lambda x: 2 * (x - 3), np.zeros(2), 2000, 0.05), 3, atol=0.05)


def test_words_are_split_at_ascii_space_only():
    words = textvec.Words(["a\u00a0b\x0bc\x1cd  e".encode(), b"", b"a"])
    assert words.counts.tolist() == [3, 0, 1] and words.hashes[0] != words.hashes[3]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.conftest import prose

    rng = random.Random(3)
    leak = prose(rng, 30)
    rows = [(i, prose(rng, 60)) for i in range(40)]
    rows += [(50, rows[0][1]), (51, rows[1][1] + " "), (52, f"{prose(rng, 40)} {leak} {prose(rng, 20)}"), (53, prose(rng, 50) + " token=abcdef123456"), (54, None), (55, "")]
    bad = [(i, " ".join(w + "%%%" for w in prose(rng, 60).split())) for i in range(60, 90)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + bad], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i, _ in rows[:40] + bad], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = docs
    kept = []
    for _, f in corpus_pipeline.STAGES[:4]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
        kept.append({r["doc_id"]: r["text"] for r in stage.collect()})
    assert set(kept[0]) == {i for i, _ in rows}
    assert set(kept[1]) == set(kept[0]) - {50, 51, 55}  # 54 and 55 are both without words
    assert set(kept[2]) == set(kept[1]) - {52} and set(kept[3]) == set(kept[2])
    assert kept[3][53].endswith(" [SECRET]") and kept[3][0] == rows[0][1]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(kept[3])


def test_pipeline_stages_take_empty_and_odd_tables(spark, docs, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        assert f(spark, empty, str(tmp_path)).count() == 0
        out = f(spark, docs, str(tmp_path))
        assert out.count() > 0 and (k == 4 or out.columns == docs.columns)
