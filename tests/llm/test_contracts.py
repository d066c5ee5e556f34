"""Operators with a contract, against brute force on a small table with odd cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sparkweave.llm import langid, packing, secrets, shingles, simhash, substring, textvec, topk, toxicity, urlfilter


def key(row):
    return tuple((x is None, x) for x in row)


def test_secrets_match_plain_patterns(spark, docs, rows, empty):
    planted = rows + [
        (200, "x password = 'abcDEF123' and token:short api-key=no API_KEY = abc/def+ghi="), (201, "AKIA" + "A1" * 8 + "z AKIA123"), (202, "deadbeef" * 4 + " " + "0" * 23 + " ſecret: abcdefgh"),
        (203, "token=a secret=\"bcdefg\" passwd:::x"), (204, "deadbeef" * 4 + " " + "0" * 23 + " ſecret: abcdefgh"),
    ]
    table = spark.createDataFrame(planted, "doc_id bigint, text string")
    rules = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )

    def expected(text):
        spans = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(rules) for m in p.finditer(text or "") if ok(m)]
        return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]

    found = secrets.scan_secrets(table).collect()
    base = {"assign", "access", "hex"}
    got = sorted((key((r["doc_id"], [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in base])) for r in found), key=repr)
    assert got == sorted((key((i, expected(t))) for i, t in planted), key=repr)
    assert secrets.scan_secrets(empty).count() == 0
    assert secrets.scan_secrets(docs).count() == len(rows)


def test_ledger_scans_each_blob_and_rule_version_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "plain")], "doc_id bigint, text string")
    path = str(tmp_path / "ledger")
    secrets.scan_secrets(docs, path)
    ledger = secrets.BlobLedger(spark, path)
    assert ledger.seen().count() == 2
    more = docs.union(spark.createDataFrame([(4, "secret: 12345678"), (5, "plain")], docs.schema))
    secrets.scan_secrets(more, path)
    assert ledger.seen().count() == 3
    newer = tuple(secrets.Rule(r.kind, r.pattern, r.least, r.group, r.ignore_case, r.hints, 2) if r.kind == "hex" else r for r in secrets.BASE_RULES + secrets.MORE_RULES)
    found = secrets.scan_secrets(more, path, newer)
    rescans = [r["versions"] for r in ledger.seen().collect() if r["versions"] == ["hex@2"]]
    assert len(rescans) == 3
    assert {r["doc_id"]: len(r["spans"]) for r in found.collect()} == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}


def test_ledger_gives_only_what_current_rule_versions_found(spark, tmp_path):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIEabcdefghijklmnop\nqrstuvwxyzABCDEFGH==\n-----END RSA PRIVATE KEY-----"
    cut = "x -----BEGIN PRIVATE KEY-----\nMIIEabcdefghijklmnop\nqrstuvwxyzABCDEFGH end"
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, key), (3, None), (4, cut)], "doc_id bigint, text string")
    path = str(tmp_path / "ledger")

    def spans(rules):
        return {r["doc_id"]: [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["spans"]] for r in secrets.scan_secrets(docs, path, rules).collect()}

    every = secrets.BASE_RULES + secrets.MORE_RULES
    pem = [(0, 3, "pem", len(key))]
    assert spans(every) == {1: [(0, 0, "assign", 14)], 2: pem, 3: [], 4: [(2, 3, "pem", len(cut) - 4)]}
    # a revision of a rule with hits, and one that finds less
    newer = tuple(secrets.Rule("assign", "token=[a-c]+", 3, revision=2) if r.kind == "assign" else r for r in every)
    assert spans(newer) == {1: [(0, 0, "assign", 9)], 2: pem, 3: [], 4: [(2, 3, "pem", len(cut) - 4)]}
    assert spans(secrets.BASE_RULES) == {1: [(0, 0, "assign", 14)], 2: [], 3: [], 4: []}
    assert spans((secrets.MORE_RULES[0],))[2] == [(0, 0, "pem", len(key))]


def test_masking_covers_whole_spans(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefgh b", 18, "k"), (2, None, None, "k"), (3, "clean", 5, None)], "doc_id bigint, text string, n_chars bigint, blob string")
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["blob"]) for r in secrets.mask_secrets(docs).collect()}
    assert got == {1: ("a [SECRET] b", 12, "k"), 2: (None, None, "k"), 3: ("clean", 5, None)}


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=20).astype(np.float32)]) for i in range(300)]
    vectors += [(300 + i, vectors[100][1]) for i in range(30)] + [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (None, [1.0]), (500, [1.0, 2.0]), (600, [])]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").repartition(4)
    queries = table.where("vec_id % 100 = 0")
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, qv in ok:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)[:10]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    got = {tuple(r) for r in topk.top_k(table, queries, query_block=3, sample=20, chunk=64).collect()}
    assert got == want
    assert topk.top_k(table, table.where("false")).count() == 0
    assert topk.top_k(table.where("vec_id < 4"), table.where("vec_id = 0")).count() == 3
    huge = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [3.0, -5.0])], "vec_id bigint, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(huge, huge.where("vec_id = 0")).orderBy("rank").collect()] == [1, 2]


def test_languages_held_out(spark, empty):
    import random

    rng = random.Random(1)
    vocabulary = {"aa": "wolu zami keto", "bb": "ston greft plix", "cc": "eaui oiea uioa"}
    rows = [(i, " ".join(rng.choice(vocabulary[lang].split()) + rng.choice(["", "n", "s"]) for _ in range(12)), lang) for i, lang in enumerate(list(vocabulary) * 30)]
    rows += [(500, None, "aa"), (501, "", None), (502, "123 !?", "bb"), (503, "Zami-ketos, WOLU", None), (504, "zami keto " * 5000, None), (None, "ston greft", None), (505, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    from pyspark.sql import functions as F

    aside = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = langid.identify_language(docs, aside).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows[:90])
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows[:90])
    assert [by[i]["lang_pred"] for i in (500, 501, 502, 503, 504, None)] == ["und", "und", "und", "aa", "aa", "bb"]
    assert by[505]["lang_pred"] in vocabulary and all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify_language(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_bloom_corrects_false_positives():
    grams = [np.arange(1, 4000, dtype=np.uint32) * np.uint32(2654435761), np.arange(1, 40, dtype=np.uint32) * np.uint32(40503)]
    f = langid.LanguageFilters.build(["x", "y"], np.array([1.0, 1.0]), grams, 12, 2)
    assert f.false_rate[0] > 0.3 > f.false_rate[1]


@pytest.fixture(scope="module")
def tokenizer():
    return packing.tokenizer_file()


def test_packing_keeps_every_token(docs, rows, empty, tokenizer):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer)
    pieces = packing.tokenize(docs, tokenizer, capacity=64).collect()
    texts = Counter(key((i, tuple(full.encode(t or "", add_special_tokens=False).ids) + (2,))) for i, t in rows)
    whole = Counter()
    opened = []
    for r in sorted(pieces, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"])):
        ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        assert len(ids) == r["length"] <= 64 and (r["piece"] == 0 or len(ids) == 64)
        opened.append((r["doc_id"], r["piece"], r["start"], ids))
    single = {i for i, n in Counter(i for i, _ in rows).items() if n == 1}
    for i in single:
        own = sorted((p, s, ids) for d, p, s, ids in opened if d == i)
        joined = sum((ids for _, _, ids in own), ())
        assert [s for _, s, _ in own] == [sum(len(x[2]) for x in own[:n]) for n in range(len(own))]
        whole[key((i, joined))] += 1
    assert whole == Counter({k: v for k, v in texts.items() if k[0][1] in single})
    packed = packing.pack(packing.tokenize(docs, tokenizer, capacity=64), 64).collect()
    assert len(packed) == len(pieces)
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= 1.1 * sum(r["length"] for r in packed) / 64 + 2
    assert packing.pack_documents(empty, tokenizer).count() == 0


def test_tokenizers_agree_on_whole_texts(tokenizer, rows):
    import json
    import random

    from tokenizers import Tokenizer

    spec = open(tokenizer, encoding="utf-8").read()
    full, encoder = Tokenizer.from_file(tokenizer), packing.Encoder(spec)
    for i in range(0x250):
        text = f"a{chr(i)}b {chr(i)} {chr(i)}{chr(i)}x\n{chr(i)} <|endoftext|>9"
        assert encoder.ids(text).tolist() == full.encode(text, add_special_tokens=False).ids, i
    rng = random.Random(8)
    common = [chr(i) for i in range(0x20, 0x250)]
    for _ in range(300):
        text = "".join(rng.choice(["the ", " and", "  ", "\n", "\t\n ", "'s", "'ll ", "12", "Ab", "\u00e9", rng.choice(common), rng.choice(common)]) for _ in range(rng.randrange(400)))
        assert encoder.ids(text).tolist() == full.encode(text, add_special_tokens=False).ids
    for _, text in rows:
        assert encoder.ids(text or "").tolist() == full.encode(text or "", add_special_tokens=False).ids
    # files that number or split otherwise go through the library
    other = json.loads(spec)
    other["model"]["merges"][:2] = reversed(other["model"]["merges"][:2])
    spaced = json.loads(spec)
    spaced["pre_tokenizer"]["add_prefix_space"] = True
    for changed in (other, spaced):
        own = packing.Encoder(json.dumps(changed))
        assert own.fast is None and own.ids("the time then").tolist() == Tokenizer.from_str(json.dumps(changed)).encode("the time then", add_special_tokens=False).ids


@pytest.mark.parametrize("order", ["longest first", "as they come"])
def test_sum_of_squares_places_where_the_sum_is_least(order):
    rng, capacity = np.random.default_rng(4), 24
    lengths = rng.integers(1, capacity + 1, 400)
    if order == "longest first":
        lengths = np.sort(lengths)[::-1]
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    gaps, needed = {}, -(-int(lengths.sum()) // capacity)

    def squares(gaps):
        return sum(n * n for g, n in Counter(gaps.values()).items() if g > 0)

    for b, offset, s in zip(bins.tolist(), offsets.tolist(), lengths.tolist()):
        options = [squares(gaps | {k: g - s}) for k, g in gaps.items() if g >= s]
        if (len(gaps) < needed or not options) and s < capacity:
            options.append(squares(gaps | {"new": capacity - s}))
        assert offset == capacity - gaps.get(b, capacity) and gaps.get(b, capacity) >= s
        gaps[b] = gaps.get(b, capacity) - s
        assert s == capacity or squares(gaps) == min(options)
    assert len(gaps) <= 1.1 * needed


def test_shards_follow_pieces(spark, tokenizer):
    docs = spark.createDataFrame([(i, "word " * 4000) for i in range(6)], "doc_id bigint, text string")
    out = packing.pack_documents(docs, tokenizer, capacity=64, shard_rows=100).collect()
    shards = Counter(r["sequence_id"] >> 40 for r in out)
    assert len(out) > 300 and len(shards) > 3 and max(shards.values()) < 150


def plain_windows(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    for i, w in words:
        covered = [False] * len(w)
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    covered[p : p + window] = [True] * window
        kept = b" ".join(x for x, c in zip(w, covered) if not c)
        yield key((i, len(w), sum(covered), hashlib.sha256(kept).hexdigest()))


@pytest.mark.parametrize("task_windows", [1_000_000, 500])
def test_substrings_match_plain_windows(docs, rows, empty, task_windows):
    found = substring.dedupe_substrings(docs, task_windows=task_windows, block_bytes=20_000).collect()
    got = Counter(key((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), hashlib.sha256(r["kept"].encode()).hexdigest())) for r in found)
    assert got == Counter(plain_windows(rows, 13))
    assert substring.dedupe_substrings(empty).count() == 0


def test_toxicity_held_out(spark, empty):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice("some plain words about nothing much at all today".split()) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(5, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = "Vilegrub"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (None, "vilegrub"), (902, "nothing " * 30_000), (902, "nothing")]
    labels += [(900, None), (None, 1), (0, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    aside = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = toxicity.classify_toxicity(docs, marks, aside).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert held and all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert [r["predicted"] for r in got if r["doc_id"] is None] == [1]
    assert toxicity.classify_toxicity(empty, marks).count() == 0
    assert all(r["score"] < 1e-20 and r["predicted"] == 0 for r in toxicity.classify_toxicity(docs, marks.where("false")).collect())


def test_urls(spark):
    urls = {
        "http://www.Example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"), "http://example.com": ("example.com", "", None, "allow"), "x://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"), "http://net/fr/": ("net", "/fr/", "net/fr/", "block"), "http://a.net/de/": ("a.net", "/de/", None, "allow"),
        "http://spam-farm.org/x": ("spam-farm.org", "/x", None, "block"), "no scheme example.com/en/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://a.com?/en/": ("a.com", "", None, "allow"), "http://a#://b.com/x": ("a", "", None, "allow"), "http://u.net/?next=http://x.com/": ("u.net", "/", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://a.net/es/1"), (0, "http://www.Example.com/en/1?x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'h' as host", "'p' as path")
    got = urlfilter.filter_urls(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i, (u, want) in enumerate(urls.items()):
        assert (by[i]["host"], by[i]["path"], by[i]["rule"], by[i]["verdict"]) == want, u
    assert urlfilter.filter_urls(pages.where("false")).count() == 0


def test_rules_stand_under_their_rarest_token():
    rules = urlfilter.default_rules()
    index, always = urlfilter.index_rules(rules, {"com": 90, "example": 80, "en": 70, "www": 10, "net": 50, "es": 5, "fr": 6})
    assert {rules[i].name for i in index["www"]} == {"www.example.com/en/"} and {rules[i].name for i in index["es"]} == {"net/es/"}
    assert all(not rules[i].tokens for i in always)


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    values = sorted(set(prints))
    for i, a in enumerate(values):
        find(a)
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_simhash_components(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_print(t) for _, t in rows]
    comps = plain_components(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[comps[p]] = min(least.get(comps[p], i), i)
    want = Counter(key((i, p, least.get(comps[p]))) for (i, _), p in zip(rows, prints))
    assert Counter(key((r["doc_id"], r["fp"] % (1 << 64), r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("longest_run", [64, 2])
def test_links_connect_all_close_fingerprints(longest_run):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (12, 90, 5), dtype=np.uint64)
    near = (centre[:, None] ^ np.bitwise_xor.reduce(flips * (rng.random(flips.shape) < 0.4).astype(np.uint64), axis=2)).ravel()
    x = np.unique(near)
    masks = simhash.segment_masks(2)
    a, b = [], []
    for chain in range(len(masks)):
        y = x[np.argsort(x & np.uint64(masks[chain]), kind="stable")]
        left, right = simhash.chain_links(y, chain, 2, masks, longest_run)
        assert (np.bitwise_count(y[left] ^ y[right]) <= 2).all() or longest_run == 2
        a.append(np.searchsorted(x, y[left]))
        b.append(np.searchsorted(x, y[right]))
    rest, root = simhash.forest(len(x), np.concatenate(a), np.concatenate(b))
    label = np.arange(len(x))
    label[rest] = root
    want = plain_components([int(v) for v in x])
    assert len(set(label.tolist())) == len(set(want.values()))
    assert len({(int(label[i]), want[int(v)]) for i, v in enumerate(x)}) == len(set(want.values()))


def test_one_row_of_each_component_stays(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    named = {i: t for i, t in rows if i is not None}
    comps = plain_components([plain_print(t) for t in named.values()])
    least = {}
    for i, t in named.items():
        c = comps[plain_print(t)]
        least[c] = min(least.get(c, i), i)
    assert set(least.values()) >= {i for i in got if i is not None and i not in (114, 115)}
    assert all(n == 1 for i, n in got.items() if i is not None)


def test_similar_texts_are_linked(spark, docs, rows, empty):
    import random

    rng = random.Random(9)
    more = []
    for k in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(150 + 40 * k)]
        more.append((1000 + 10 * k, " ".join(words)))
        for c in range(1, 4):  # J about 0.9
            other = list(words)
            other[rng.randrange(len(words))] = "changed"
            more.append((1000 + 10 * k + c, " ".join(other)))
        more.append((1000 + 10 * k + 9, " ".join(words[: len(words) // 2] + [f"v{rng.randrange(400)}" for _ in range(len(words) // 2)])))
    table = spark.createDataFrame(rows + more, "doc_id bigint, text string")
    got = {r["doc_id"]: r["root"] for r in shingles.similar(table).collect() if r["doc_id"] is not None}
    for i, _ in more:
        assert got[i] == (i if i % 10 == 9 else i - i % 10)
    kept = {r["doc_id"] for r in simhash.keep_one(table).collect()}
    assert {i for i, _ in more if i in kept} == {i for i, _ in more if i % 10 in (0, 9)}
    assert shingles.similar(empty).count() == 0
    assert shingles.likeness(b"", b"") == 1.0


def test_words_decide_about_factors():
    words = [b"w%d" % i for i in range(40)]
    found = np.zeros(2, substring._FACTOR)
    found["start"], found["n"] = [0, 20], [3, 5]
    proofs = np.array([(0, substring.proof(words, 0, 15)), (1, substring.proof(words, 21, 17))], substring._PROOF)
    assert substring.checked(found.tobytes(), [proofs[1:].tobytes(), proofs[:1].tobytes()], words, 13)["start"].tolist() == [0]
    assert len(substring.checked(None, None, words, 13)) == 0
    first = substring.first_places(np.array([7, 8, 7, 7], np.uint64), np.array([1, 0, 0, 2]), np.array([0, 0, 4, 1]))
    assert first.tolist() == [2, 1, 2, 2]


@pytest.mark.parametrize("crowded", [False, True])
def test_factors_name_their_source(spark, monkeypatch, crowded):
    import random

    rng = random.Random(6)
    if crowded:  # every anchor counts as crowded: windows travel one by one
        monkeypatch.setattr(substring, "crowded_anchors", lambda docs, window, gram, most: substring.sliding_min(np.unique(np.concatenate([textvec.Words([t.encode()]).windows(4)[0] for _, t in rows])), 1))
    pool = [f"w{i}" for i in range(40)]
    text = [[rng.choice(pool) for _ in range(120)] for _ in range(4)]
    rows = [(i, " ".join(t)) for i, t in enumerate(text)]
    rows += [(10, " ".join(text[1][20:60] + text[0][5:40] + ["new"] + text[2][:12])), (11, " ".join(text[3][90:] + text[3][:30]))]
    got = {r["doc_id"]: r for r in substring.dedupe_substrings(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), block_bytes=500).collect()}
    shown = [(f["start"], f["words"], f["source"], f["source_start"]) for f in got[10]["factors"]]
    assert shown == [(0, 40, 1, 20), (40, 35, 0, 5)] and [tuple(s) for s in got[10]["spans"]] == [(0, 75)]
    assert [(f["start"], f["words"], f["source"], f["source_start"]) for f in got[11]["factors"]] == [(0, 30, 3, 90), (30, 30, 3, 0)]
    for f in (f for r in got.values() for f in r["factors"]):
        assert f["words"] >= 13
    assert all(not got[i]["factors"] for i in range(4))


def test_all_alike_texts_are_linked_under_a_shared_passage(spark):
    """A passage of thousands of texts supplies most of their shingles: held against all pairs."""
    import random

    rng = random.Random(4)
    passage = [f"p{i}" for i in range(204)]
    rows = []
    for i in range(3000):
        rows.append((i, passage + [f"d{i}x{k}" for k in range(50)]))
    for i in range(0, 200):  # near copies (J about 0.96), far away by id
        rows.append((9000 - i, rows[7 * i][1][:-5] + ["changed"] * 5))
    for i in range(120):  # close to the threshold on both sides, more shingles than a sketch holds
        own = [f"e{rng.randrange(10**9)}" for _ in range(504)]
        other = own[: 504 - 50 - i % 12]
        rows += [(20000 + 2 * i, own), (20001 + 2 * i, other + [f"f{rng.randrange(10**9)}" for _ in range(504 - len(other))])]
    sets = [frozenset(xxhash.xxh64_intdigest(" ".join(w[k : k + 5]), 42) for k in range(len(w) - 4)) for _, w in rows]
    # any two texts with the passage and different own words are at 0.67; only planted pairs can link
    want = {i: i for i, _ in rows}
    at = {i: s for (i, _), s in zip(rows, sets)}
    linked = 0
    for a, b in [(9000 - i, 7 * i) for i in range(200)] + [(20000 + 2 * i, 20001 + 2 * i) for i in range(120)]:
        if len(at[a] & at[b]) / len(at[a] | at[b]) >= 0.8:
            want[max(a, b)] = min(a, b)
            linked += 1
    assert 200 < linked < 320
    for i in range(0, 3000, 500):
        assert all(len(sets[i] & s) / len(sets[i] | s) < 0.8 for (j, _), s in zip(rows, sets) if want[i] != want[j])
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["root"] for r in shingles.similar(table).collect()}
    assert got == want
