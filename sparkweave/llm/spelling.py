"""Grouping spelling variants: letter-parity bitmask bands.

A word's mask has a bit for each letter, set if the word holds the letter an odd number of times. One inserted
or deleted letter flips one bit, one replaced letter at most two, so of three bands of the mask at least one
stays as it is: words one edit apart agree in a band, and their lengths differ by at most one. Such an edit
also leaves one half of the words untouched, whose own parity mask then agrees in full; it is part of the join
key, so that a band shared by very many words is split without losing a pair. What meets under a key is
verified by edit distance, and counted under the first key at which it meets.

Keys are dealt by length, half and band; no group is collected, so a crowded key is a skewed join that adaptive
execution may split. The forms' chains are followed by doubling steps over the words that have one.

Defined cases: a null or empty text has no words. A very long text or run is read whole. Repeated rows count
each. A null doc_id makes its runs' hash null, so no letter of them is deleted. Ties of the largest count go to
the smallest word by code points. An empty table gives no rows. Columns other than the id and the text are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import pick, table
from sparkweave.operators.scratch import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of words: runs of these.
LETTERS = "A-Za-zÀ-ÿ"
BANDS = 3


def words_of(docs: DataFrame, least_length: int = 7, noise: int = 31) -> DataFrame:
    """word, n: lower-cased runs of letters of all texts; of every ``noise``-th run, by a hash, one letter is deleted.

    A run shorter than ``least_length`` can't become a word and is passed over by the pattern.
    """
    docs = pick(docs, doc_id="doc_id", text="text")
    low = F.translate("text", UPPER, UPPER.lower())
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{least_length},}}"), 0)).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run")))
    size = F.length("run")
    at = (F.col("h") % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    words = runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def parity_mask(text: Column) -> Column:
    """A bit per letter: 26 for a to z, 38 for the others, which share them in turns."""
    code = lambda c: F.ascii(c)
    bit = lambda c: F.when(code(c) < 128, (code(c) - 97) % 26).otherwise(26 + code(c) % 38)
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(c).cast("int"))))


def band_mask(band: int) -> int:
    """The bits of a band: every third one, so that common letters are spread over the bands."""
    bits = sum(1 << i for i in range(band, 64, BANDS))
    return bits - (1 << 64) if bits >> 63 else bits


def near_words(words: DataFrame) -> DataFrame:
    """a, b, na, nb: all pairs of words (word, n; distinct) with one letter inserted, deleted or replaced, each once.

    A word meets words of its own length and, as the shorter one, words with one letter more. Both are cut in
    halves by the shorter one's length, counted from the start for the first half and from the end for the second.
    """
    words = words.withColumn("mask", parity_mask(F.col("word")))
    size = F.length("word")

    def halves(base: Column) -> list[Column]:
        first = F.floor(base / 2).cast("int")
        return [parity_mask(F.substring("word", F.lit(1), first)), parity_mask(F.substring("word", size - (base - first) + 1, base - first))]

    def keyed(rows: DataFrame, base: Column, longer: bool) -> DataFrame:
        rows = rows.withColumn("base", base).withColumn("halves", F.array(*halves(F.col("base"))))
        keys = [
            F.struct(F.lit(half * BANDS + band).alias("meet"), F.xxhash64(F.lit(half * BANDS + band), "base", F.col("mask").bitwiseAND(F.lit(band_mask(band))), F.col("halves")[half]).alias("key"))
            for half in range(2)
            for band in range(BANDS)
        ]
        return rows.select("word", "n", "mask", "halves", "base", F.lit(longer).alias("longer"), F.explode(F.array(*keys)).alias("k")).select("word", "n", "mask", "halves", "base", "longer", "k.meet", "k.key")

    own = keyed(words, size, False)
    right = own.unionByName(keyed(words.where(size > 1), size - 1, True))
    left = own.drop("longer")
    a, b = left.select(*(F.col(c).alias(f"a_{c}") for c in left.columns)), right.select(*(F.col(c).alias(f"b_{c}") for c in right.columns))
    on = (F.col("a_key") == F.col("b_key")) & (F.col("a_meet") == F.col("b_meet")) & (F.col("a_base") == F.col("b_base")) & (F.col("b_longer") | (F.col("a_word") < F.col("b_word")))
    # the first of the keys at which a pair meets
    flipped = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    first = F.lit(2 * BANDS)
    for half in (1, 0):
        for band in reversed(range(BANDS)):
            agree = (F.col("a_halves")[half] == F.col("b_halves")[half]) & (flipped.bitwiseAND(F.lit(band_mask(band))) == 0)
            first = F.when(agree, half * BANDS + band).otherwise(first)
    few = F.bit_count(flipped) <= 2
    met = a.join(b, on & few & (F.col("a_meet") == first) & (F.levenshtein("a_word", "b_word", 1) == 1))
    return met.select(F.col("a_word").alias("a"), F.col("b_word").alias("b"), F.col("a_n").alias("na"), F.col("b_n").alias("nb"))


def forms_of(words: DataFrame, scratch: Scratch, times: int = 10) -> DataFrame:
    """word, form, form_n, n_near of words that have a near one; form is null where no near word is ``times`` as frequent."""
    pairs = scratch.cut(near_words(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.first("na").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("less"), "b")).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    return best.select("word", F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"), "n_near")


def roots_of(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of words with a form (word, form): the last of the chain of forms.

    Counts grow along a chain, so it ends; each step doubles how far a word sees.
    """
    steps = scratch.cut(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = scratch.cut(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ahead.where("moved").isEmpty():
            return ahead.select("word", "root")
        steps = ahead.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_n: int = 2, times: int = 10, noise: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.cut(words_of(docs, least_length, noise).where(F.col("n") >= least_n))
    forms = scratch.cut(forms_of(words, scratch, times))
    roots = roots_of(forms, scratch)
    out = words.join(forms, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("form_n").cast("bigint").alias("form_n"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The hash by its rule, byte by byte; edit distance on words whose other letters stand for themselves in ASCII.
OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) AS r(i))
), low AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM low GROUP BY ALL
), coded AS (
  SELECT run, n, length(run) AS size, hex(encode(doc_id::VARCHAR || ':' || run)) AS code FROM counted
), hashed AS (
  SELECT run, n, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(code) + 1, 2), lambda i: ('0x' || substr(code, i, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) AS h FROM coded, crc_table
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word, n FROM hashed
), w AS (
  SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS (
  SELECT word, n, word AS cut FROM w
  UNION SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.word <> b.word
  WHERE abs(length(a.word) - length(b.word)) <= 1
), checked AS (
  SELECT * FROM near WHERE length(word) <> length(other) OR len(list_filter(range(1, length(word) + 1), lambda i: substr(word, i, 1) <> substr(other, i, 1))) = 1
), best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, max(m) AS top, arg_min(other, (-m, encode(other))) AS other FROM checked GROUP BY word
), forms AS (
  SELECT word, CASE WHEN top >= 10 * n THEN other END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n, n_near FROM best
), chain AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), last AS (
  SELECT c.word, c.root FROM chain c LEFT JOIN forms f ON f.word = c.root WHERE f.form IS NULL
)
SELECT w.word, forms.form, coalesce(last.root, w.word) AS root, w.n, coalesce(forms.n_near, 0)::BIGINT AS n_near, forms.form_n::BIGINT AS form_n
FROM w LEFT JOIN forms ON forms.word = w.word LEFT JOIN last ON last.word = w.word
"""
