"""Mining collocations: contiguous pattern growth over projected occurrence pointers, as PrefixSpan does it.

Texts become sequences of word ids (64-bit hashes of language and word, whose collisions are looked for and
lead to another seed), broken at punctuation and at words too rare to be part of a phrase. Frequent words and
pairs are counted first. Then each occurrence of a frequent pair that a frequent pair goes on from is projected:
its pointer is the pair, the prefix, and the words that follow as far as pairs stay frequent. Equal pointers of
a task travel as one with their number. All pointers of a prefix meet in one task, which extends the prefix to
the right, depth first: it counts the next words, keeps the frequent ones and goes on within the pointers of each.

A prefix with more pointers than ``task_pointers`` would be too much for one task. It is grown by one word by a
grouped count, and the longer prefixes are dealt anew. Filters of at most 2 ** 24 bits tell tasks which words
and pairs are frequent; a full filter lets more through and loses nothing, as counts decide in the end.

Defined cases: a null text has no words, a null language is ``und``. Very long texts and words are read whole.
Repeated rows count each. Ties of the score go to the more frequent phrase, then to the smaller one in the order
of its UTF-8 bytes. An empty table gives no rows. Columns other than text and lang are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.llm import textvec
from sparkweave.llm.common import table
from sparkweave.llm.members import MOST_BITS
from sparkweave.operators.scratch import Scratch

U64 = np.uint64
LONGEST = 5
#: Kinds of bytes: 0 in words, 1 between words, 2 between pieces.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 2
COLUMNS = ("a", "b", "c", "d", "e")


class Tokens:
    """Word ids of many texts in order, and where pieces end."""

    def __init__(self, texts: list[str], langs: list[str], seed: int):
        coded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        self.text = b"\n".join(coded)
        data = np.frombuffer(self.text, np.uint8)
        kinds = KINDS[data]
        inside = np.concatenate([[False], kinds == 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        hashes = textvec.stretch_hashes(textvec._BYTES[data[kinds == 0]], self.ends - self.starts)
        begin = np.cumsum([0, *(len(c) + 1 for c in coded)])
        self.of = np.searchsorted(begin, self.starts, "right") - 1
        salts = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=8).digest(), "little") for lang in langs] or [0], U64)
        ids = textvec.mix(hashes ^ salts[self.of]) if len(self.of) else hashes
        self.ids = np.where(ids == 0, U64(1), ids)
        pieces = np.cumsum(kinds == 2)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.new_piece = np.concatenate([[False], pieces[1:] != pieces[:-1]]) if len(pieces) else np.zeros(0, bool)

    def sequence(self, kept: np.ndarray) -> np.ndarray:
        """The ids, zero for those not kept, with a zero between pieces and one at the end."""
        out = np.zeros(len(self.ids) + int(self.new_piece.sum()) + 1, U64)
        out[np.arange(len(self.ids)) + np.cumsum(self.new_piece)] = np.where(kept, self.ids, U64(0))
        return out


def read(batches: Iterator[pa.RecordBatch], seed: int, max_chars: int = 1 << 22) -> Iterator[tuple[Tokens, list[str]]]:
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for start, group in textvec.groups(texts, max_chars):
            own = langs[start : start + len(group)]
            yield Tokens(group, own, seed), own


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return textvec.mix(first * textvec.BASE + second)


def is_member(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & U64(len(bits) * 64 - 1)
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def member_bits(keys: DataFrame) -> np.ndarray:
    """A filter of the keys (column key, evenly spread bits), as an array of at most 2 ** MOST_BITS bits."""
    bits = min(MOST_BITS, max(12, (16 * keys.count()).bit_length()))
    place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    rows = keys.select(F.shiftright(place, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("at").agg(F.expr("bit_or(bit)").alias("word"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for at, word in rows.collect():
        out[at] = word
    return out.view(U64)


def combined(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns and how often each stands there."""
    counts = np.ones(len(columns[0]), np.int64) if counts is None else counts
    if not len(counts):
        return columns, counts
    order = np.argsort(reduce(pair_keys, columns), kind="stable")
    columns = [c[order] for c in columns]
    starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
    return [c[starts] for c in columns], np.add.reduceat(counts[order], starts)


def rows_of(columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(counts)], [*COLUMNS[: len(columns)], "n"])


def in_portions(sequences: Iterator[np.ndarray], windows: Callable[[np.ndarray], list[np.ndarray]], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Counted windows of sequences, gathered until they are many."""
    parts: list[list[np.ndarray]] = []
    size = 0
    for sequence in sequences:
        parts.append(windows(sequence))
        size += len(parts[-1][0])
        if size >= most:
            yield rows_of(*combined([np.concatenate(c) for c in zip(*parts)]))
            parts, size = [], 0
    if size:
        yield rows_of(*combined([np.concatenate(c) for c in zip(*parts)]))


def pairs_in(sequence: np.ndarray) -> list[np.ndarray]:
    first, second = sequence[:-1], sequence[1:]
    both = (first != 0) & (second != 0)
    return [first[both], second[both]]


def pointers_in(sequence: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    """Occurrences of frequent pairs that a frequent pair goes on from: the pair and up to three words after it."""
    s = np.concatenate([sequence, np.zeros(LONGEST, U64)])
    hit = (s[:-1] != 0) & (s[1:] != 0)
    hit[hit] = is_member(bits, pair_keys(s[:-1][hit], s[1:][hit]))
    at = np.flatnonzero(hit[:-1] & hit[1:])
    d = np.where(hit[at + 2], s[at + 3], U64(0))
    e = np.where((d != 0) & hit[np.minimum(at + 3, len(hit) - 1)], s[np.minimum(at + 4, len(s) - 1)], U64(0))
    return [s[at], s[at + 1], s[at + 2], d, e]


def grow(columns: list[np.ndarray], counts: np.ndarray, depth: int, least: int) -> tuple[list[list[int]], list[int]]:
    """All frequent phrases that extend the prefixes of ``depth`` words, depth first, from sorted pointers."""
    phrases: list[list[int]] = []
    found: list[int] = []

    def extend(prefix: list[int], lo: int, hi: int, depth: int) -> None:
        words = columns[depth][lo:hi]
        starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        totals = np.add.reduceat(counts[lo:hi], starts)
        stops = np.append(starts[1:], hi - lo)
        for i in np.flatnonzero((totals >= least) & (words[starts] != 0)):
            longer = [*prefix, int(words[starts[i]])]
            phrases.append(longer)
            found.append(int(totals[i]))
            if depth + 1 < len(columns):
                extend(longer, lo + int(starts[i]), lo + int(stops[i]), depth + 1)

    if len(counts):
        changes = np.any([c[1:] != c[:-1] for c in columns[:depth]], axis=0)
        starts = np.flatnonzero(np.concatenate([[True], changes]))
        stops = np.append(starts[1:], len(counts))
        enough = np.add.reduceat(counts, starts) >= least
        for lo, hi in zip(starts[enough].tolist(), stops[enough].tolist()):
            extend([int(c[lo]) for c in columns[:depth]], lo, hi, depth)
    return phrases, found


PHRASES = "ids array<bigint>, f bigint"


def grown(pointers: DataFrame, least: int, task_pointers: int, scratch: Scratch) -> DataFrame:
    """ids, f of all frequent phrases of three words and more, from pointers (a, b, c, d, e, n; a written table)."""
    out, depth = [], 2
    while True:
        prefix = list(COLUMNS[:depth])
        crowded = scratch.cut(pointers.groupBy(*prefix).agg(F.count("*").alias("rows")).where(F.col("rows") > task_pointers).select(*prefix))
        split = depth + 1 < LONGEST and not crowded.isEmpty()
        own = pointers.join(crowded, prefix, "left_anti") if split else pointers
        # many small groups, so that those that meet in a task are about as large everywhere
        parts = max(1, -(-own.count() // max(1, task_pointers // 4)))
        own = own.withColumn("part", F.pmod(F.xxhash64(*prefix), F.lit(parts)).cast("int"))
        out.append(own.groupBy("part").applyInArrow(_grower(depth, least), PHRASES))
        if not split:
            break
        longer = list(COLUMNS[: depth + 1])
        rest = pointers.join(crowded, prefix, "left_semi")
        frequent = scratch.cut(rest.where(F.col(longer[-1]) != 0).groupBy(*longer).agg(F.sum("n").alias("f")).where(F.col("f") >= least))
        out.append(frequent.select(F.array(*longer).alias("ids"), "f"))
        pointers = scratch.cut(rest.join(frequent.select(*longer), longer, "left_semi").where(F.col(COLUMNS[depth + 1]) != 0))
        depth += 1
    return reduce(DataFrame.unionByName, out)


def _grower(depth: int, least: int):
    def run(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_numpy().view(U64) for c in COLUMNS]
        order = np.lexsort(columns[::-1])
        phrases, found = grow([c[order] for c in columns], group.column("n").to_numpy()[order], depth, least)
        ids = np.array([x for p in phrases for x in p], U64).view(np.int64)
        offsets = np.cumsum([0, *map(len, phrases)])
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int64())), "f": pa.array(found, pa.int64())})

    return run


def words_of(docs: DataFrame, seed: int) -> DataFrame:
    """id, lang, word, n of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, langs in read(batches, seed):
            ids, first, counts = np.unique(tokens.ids, return_index=True, return_counts=True)
            words = [tokens.text[a:b].decode("utf-8", "surrogatepass") for a, b in zip(tokens.starts[first].tolist(), tokens.ends[first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array([langs[i] for i in tokens.of[first].tolist()], pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["id", "lang", "word", "n"])

    return docs.mapInArrow(run, "id bigint, lang string, word string, n bigint").groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = 100, task_pointers: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word, n) of all words, and (ids, f) of all phrases of one to five words that stand there ``least`` times."""
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    sc = docs.sparkSession.sparkContext
    for seed in range(8):
        words = scratch.cut(words_of(docs, seed))
        if words.groupBy("id").count().where("count > 1").isEmpty():
            break
        scratch.drop(words)
    else:
        raise RuntimeError("words share hashes with every seed")
    frequent = words.where(F.col("n") >= least)
    known = sc.broadcast(member_bits(frequent.select(F.col("id").alias("key"))))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_portions((t.sequence(is_member(known.value, t.ids)) for t, _ in read(batches, seed)), pairs_in)

    pairs = docs.mapInArrow(count_pairs, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("f"))
    pairs = scratch.cut(pairs.where(F.col("f") >= least))
    keys = pairs.mapInArrow(_pair_key_rows, "key bigint")
    going = sc.broadcast(member_bits(scratch.cut(keys)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_portions((t.sequence(is_member(known.value, t.ids)) for t, _ in read(batches, seed)), lambda s: pointers_in(s, going.value))

    pointers = scratch.cut(docs.mapInArrow(project, "a bigint, b bigint, c bigint, d bigint, e bigint, n bigint"))
    longer = grown(pointers, least, task_pointers, scratch)
    single = frequent.select(F.array("id").alias("ids"), F.col("n").alias("f"))
    return words, scratch.cut(reduce(DataFrame.unionByName, [single, pairs.select(F.array("a", "b").alias("ids"), "f"), longer]))


def _pair_key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pair_keys(*(batch.column(c).to_numpy().view(U64) for c in "ab"))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def maximal(phrases: DataFrame) -> DataFrame:
    """Phrases of two words and more that no longer phrase holds as often.

    A longer phrase that holds one as often has a part with one word more that does so, too.
    """
    size = F.size("ids")
    parts = F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))
    held = phrases.where(size >= 3).select(F.explode(parts).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("held"))
    return phrases.where(size >= 2).join(held, "ids", "left").where(F.col("held").isNull() | (F.col("held") < F.col("f"))).drop("held")


def scored(phrases: DataFrame, every: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrases (ids, f): the cut with the lowest score counts, the first of equal ones."""
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    spelled = phrases.select("ids", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("rest"))
    cuts = cuts.join(every.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(every.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    rows = cuts.join(spelled, "ids").join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(18,0)")
    # whole numbers below 10 ** 38: 18 and 19 digits, 18 and 18
    score = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(14,0)")) * big("n"), big("l") * big("r"))
    rows = rows.withColumn("score", score)
    best = rows.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, task_pointers: int = 250_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` first phrases of each language."""
    scratch = Scratch(docs.sparkSession)
    words, every = frequent_phrases(docs, scratch, least, task_pointers)
    rows = scored(scratch.cut(maximal(every)), every, words)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), places AS (
  SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM split, range(1, 6) AS s(k)
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM split GROUP BY lang
), f AS (
  SELECT lang, list_slice(ws, i, i + k - 1) AS p, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100
), inner_parts AS (
  SELECT lang, list_slice(p, i, i + k - 1) AS p, f FROM (SELECT lang, p, f, k, unnest(range(1, len(p) - k + 2)) AS i FROM f, range(2, 5) AS s(k) WHERE len(p) > k)
), kept AS (
  SELECT f.* FROM f WHERE len(p) >= 2 AND NOT EXISTS (SELECT 1 FROM inner_parts x WHERE x.lang = f.lang AND x.p = f.p AND 100 * x.f >= 100 * f.f)
), cuts AS (
  SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM kept
), cut_scores AS (
  SELECT c.lang, c.p, c.a, c.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN totals t USING (lang) JOIN f l ON l.lang = c.lang AND l.p = list_slice(c.p, 1, c.k) JOIN f r ON r.lang = c.lang AND r.p = list_slice(c.p, c.k + 1, len(c.p))
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS o FROM cut_scores
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM lowest WHERE o = 1
)
SELECT * FROM ranked WHERE rank <= 2000
"""
