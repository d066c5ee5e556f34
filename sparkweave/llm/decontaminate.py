"""Benchmark decontamination: containment search with size-partitioned MinHash, verified exactly.

A document is contaminated by an item if it holds at least ``threshold`` of the item's distinct word
shingles. Documents are partitioned by size (a power of two that bounds their shingles). Within a
partition the hash range is cut into ``density`` bins a shingle, and the MinHash signature of a document
is the smallest of its hashes in each bin. Items get a signature for each partition with the same bins; a
common entry makes a candidate. As the bins grow with the partition's bound, a shingle that a long
document contains is the smallest of its bin with a probability that does not depend on the document's
length (about (1 - exp(-1 / density)) * density, 0.88 for 4), so that short items are found in documents of
any size: an item of q shingles is missed with about 0.12 ** (threshold * q). Items too short for that
(``least_shingles``) are looked up with all their shingles, in the same pass over the documents' shingles;
that leaves the others to the signatures.

What the benchmark gives is broadcast if its bytes, added up, are few. Else a filter of bounded size lets
those of the documents' shingles through that the benchmark may have, and these few meet it in a shuffle.

Candidates are then verified with the shingles themselves. All of it is DataFrame functions: no Python
runs on the executors.

Defined cases: words are the runs of letters and digits of the lower-cased text. A text of fewer words
than a shingle is one shingle, without words none; so an item of fewer words than a shingle is found only in
documents of just these words. Very long texts are read whole. Null texts and items are empty; an empty
benchmark, or an item without words, contaminates nothing, and an empty table gives no rows. Rows with equal
id and text are one document, rows with equal id and other text are judged apart; a null id is kept and
judged like any other. Items with equal id are judged apart by their text; items that tie are all reported.
Columns other than ids and texts are not read; ``drop_contaminated`` hands them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import pick, table
from sparkweave.llm.members import Members
from sparkweave.operators.scratch import Scratch

#: Most bytes of the benchmark's shingles that are sent to all executors.
MAX_BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_count(words: Column, size: int) -> Column:
    return F.when(F.size(words) >= size, F.size(words) - size + 1).when(F.size(words) > 0, 1).otherwise(0)


def shingle_at(words: Column, at: Column, size: int) -> Column:
    """Text of the shingle that starts at word ``at`` (from 0)."""
    return F.array_join(F.slice(words, at + 1, F.lit(size)), " ")


def hash_at(hashes: Column, at: Column, size: int) -> Column:
    """Hash of the shingle at ``at`` from the hashes of its words (null beyond the end)."""
    return F.xxhash64(*(F.get(hashes, at + i) for i in range(size)))


def hashed(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """key, h: the distinct shingle hashes of each row, as a sorted array.

    Each step comes out of a generator of one row, which keeps the optimizer from writing the steps into
    one another and so computing them again for each use.
    """
    hashes = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    rows = rows.select(*key, F.explode(F.array(hashes)).alias("w")).select(*key, "w", shingle_count(F.col("w"), size).alias("n"))
    every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: hash_at(F.col("w"), i, size))
    every = F.when(F.col("n") > 0, F.sort_array(F.array_distinct(every))).otherwise(F.array().cast("array<bigint>"))
    return rows.select(*key, F.explode(F.array(every)).alias("h"))


def bound_of(h: Column) -> Column:
    """The partition of a document: the least power of two, 32 or more, that bounds its shingles."""
    return F.greatest(F.lit(5), F.ceil(F.log2(F.size(h).cast("double"))).cast("int"))


def bin_of(h: Column, bits: Column) -> Column:
    """Bin of a hash among 2 ** bits: its leading bits."""
    return F.call_function("shiftrightunsigned", h, F.lit(64) - bits)


def signature(h: Column, bits: Column) -> Column:
    """Smallest hash of each bin, from sorted hashes: they lie bin by bin (signed order keeps bins together)."""
    return F.filter(h, lambda x, i: (i == 0) | (bin_of(x, bits) != bin_of(F.get(h, i - 1), bits)))


def least_bits(h: Column) -> Column:
    """For sorted hashes: x, and the number of bits from which on it is in the signature.

    Bins of more bits lie within bins of fewer, so what is smallest in a bin stays so: a hash enters with the
    first bit in which it differs from the one before it.
    """
    first = F.transform(h, lambda x, i: F.when(i == 0, 0).otherwise(F.lit(65) - F.length(F.bin(x.bitwiseXOR(F.get(h, i - 1))))))
    return F.arrays_zip(h.alias("x"), first.cast("array<int>").alias("bits"))


def joined(rows: DataFrame, small: DataFrame, on: str, key: Column, scratch: Scratch) -> DataFrame:
    """``rows`` with those of ``small`` (a written table) that have the same ``on``; ``key``: a hash of it."""
    row = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in small.columns), F.lit(16 * len(small.columns)))
    size = small.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]
    if size <= MAX_BROADCAST_BYTES:
        return rows.join(F.broadcast(small), on)
    return Members.of(small, key, scratch).split(rows, key)[0].join(small, on)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, size: int = 5, density_bits: int = 2, least_shingles: int = 8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, digest (of the text), item_id, containment, item_shingles of every contaminated document and item."""
    scratch = Scratch(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    items = pick(benchmark, item_id=item_id, text=item_text).dropDuplicates().select("item_id", F.xxhash64("text").alias("item_digest"), "text")
    item_hashes = scratch.cut(hashed(items, ["item_id", "item_digest"], size).where(F.size("h") > 0))

    # signatures of the items for all partitions at once; short ones (least 0) with all their shingles
    entries = F.when(F.size("h") < least_shingles, F.arrays_zip(F.col("h").alias("x"), F.transform("h", lambda x: F.lit(0)).alias("bits"))).otherwise(
        F.transform(least_bits(F.col("h")), lambda e: F.struct(e["x"].alias("x"), (e["bits"] + 1).alias("bits")))
    )
    sketch = scratch.cut(item_hashes.select("item_id", "item_digest", F.inline(entries).alias("value", "least")))

    own = hashed(docs.select("doc_id", "digest", "text"), ["doc_id", "digest"], size)
    own = own.select("doc_id", "digest", "h", (bound_of(F.col("h")) + density_bits).alias("bits"))
    # each shingle hash once, with whether it is in the document's signature
    places = F.transform("h", lambda x, i: F.struct(x.alias("value"), ((i == 0) | (bin_of(x, F.col("bits")) != bin_of(F.get("h", i - 1), F.col("bits")))).alias("signs")))
    probes = own.select("doc_id", "digest", "bits", F.inline(places).alias("value", "signs"))
    candidates = joined(probes, sketch, "value", F.col("value"), scratch)
    candidates = candidates.where((F.col("least") == 0) | (F.col("signs") & (F.col("bits") >= F.col("least") - 1))).select("doc_id", "digest", "item_id", "item_digest").distinct()
    candidates = scratch.cut(candidates)

    # verification with the texts of shingles, for candidates only
    def shingled(rows: DataFrame, *key: str) -> DataFrame:
        w = rows.select(*key, F.explode(F.array(words_of(F.col("text")))).alias("w"))
        places = F.when(F.size("w") > 0, F.sequence(F.lit(0), shingle_count(F.col("w"), size) - 1))
        w = w.select(*key, "w", F.explode(places).alias("at"))
        return w.select(*key, shingle_at(F.col("w"), F.col("at"), size).alias("shingle"))

    item_rows = scratch.cut(shingled(items, "item_id", "item_digest").distinct())
    sizes = item_rows.groupBy("item_id", "item_digest").agg(F.count("*").alias("item_shingles"))
    suspects = candidates.select("doc_id", "digest").distinct().withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    suspect_rows = docs.join(suspects, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("digest").eqNullSafe(F.col("_digest")), "left_semi")
    # only shingles that some item has go on
    hits = joined(shingled(suspect_rows, "doc_id", "digest"), item_rows, "shingle", F.xxhash64("shingle"), scratch).distinct()
    held = hits.groupBy("doc_id", "digest", "item_id", "item_digest").agg(F.count("*").alias("held"))
    c = candidates.withColumnsRenamed({x: f"_{x}" for x in candidates.columns})
    same = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in candidates.columns]
    held = held.join(c, same[0] & same[1] & same[2] & same[3], "left_semi")
    s = sizes.withColumnsRenamed({"item_id": "_item", "item_digest": "_item_digest"})
    found = held.join(s, F.col("item_id").eqNullSafe(F.col("_item")) & F.col("item_digest").eqNullSafe(F.col("_item_digest")))
    return found.where(F.col("held") >= threshold * F.col("item_shingles")).select("doc_id", "digest", "item_id", (F.col("held") / F.col("item_shingles")).alias("containment"), F.col("item_shingles").cast("int").alias("item_shingles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    found = contaminated(docs, benchmark, threshold, size)
    found = Scratch(docs.sparkSession).cut(found.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__digest")), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, containment, item_shingles of every contaminated document and item."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("containment", 6).alias("containment"), "item_shingles")


OP6_SQL = r"""
WITH t AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
  SELECT side, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM t
), s AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM w
), n AS (
  SELECT id, count(*) AS n FROM s WHERE side = 1 GROUP BY id
)
SELECT d.id AS doc_id, b.id AS item_id, round(count(*) / CAST(max(n.n) AS DOUBLE), 6) AS containment, CAST(max(n.n) AS INTEGER) AS item_shingles
FROM s d JOIN s b ON d.side = 0 AND b.side = 1 AND d.shingle = b.shingle JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * max(n.n)
"""
