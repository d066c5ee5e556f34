"""SimHash near-duplicates, linked by a pigeonring filter.

A fingerprint has a bit set where more than half of the text's shingle hashes have it set. Two texts link
if their fingerprints differ in at most ``radius`` bits.

Pigeonring: the 64 bits stand in a ring of segments. If two fingerprints differ in at most r bits, then
some segment starts a chain whose first l segments together differ in at most l * r / segments bits, for
every l. With radius + 1 segments the first one of the chain must be equal, so it is the index key; the
following chain budgets prune candidates, and the full Hamming distance decides.

Equal fingerprints are one node, so copies never meet as pairs. Runs of fingerprints with the same key are
compared in place while they are short; long runs are split by the chain's next segment, whatever their
number. Only a spanning forest of each group's links leaves it. Components then come from alternating stars.

``shingles.similar`` links texts by their five-word shingles instead, for copies with more edits than two
bits stand for; ``keep_one`` takes both kinds of links.

Defined cases: a null text is the empty text; texts without words have fingerprint zero and link like any
other. A very long text is read whole. Repeated rows, and texts that tie in their fingerprint, share a node.
Rows with a null id get a fingerprint, but do not name a component: theirs is null if no row of it has an id.
An empty table gives no rows. Columns other than the id and the text are not read; ``keep_one`` hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkweave.llm import textvec
from sparkweave.llm.common import pick, table
from sparkweave.llm.members import Members
from sparkweave.llm.shingles import similar
from sparkweave.operators.components import connected_components
from sparkweave.operators.scratch import Scratch

U64 = np.uint64


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of the lower-cased (A-Z) words, repeats included."""
    words = text.lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(x), 42) for x in zip(*(words[i:] for i in range(size)))]


def fingerprints_of(texts: list[bytes], size: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text."""
    out = np.zeros(len(texts), U64)
    lists = [shingle_hashes(t, size) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    full = np.flatnonzero(counts)
    if len(full):
        h = np.fromiter((x for own in lists for x in own), U64, int(counts.sum()))
        starts = (np.cumsum(counts) - counts)[full]
        for bit in range(64):
            ones = np.add.reduceat(((h >> U64(bit)) & U64(1)).astype(np.int32), starts)
            out[full] |= (2 * ones > counts[full]).astype(U64) << U64(bit)
    return out


def fingerprint(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number) of every row of doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.portions(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = [fingerprints_of(group, size) for _, group in textvec.groups(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0, U64), *found]).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def segment_masks(radius: int) -> list[int]:
    """Bit masks of radius + 1 segments of nearly equal width."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def near_pairs(x: np.ndarray, key: np.ndarray, start: int, radius: int, masks: list[int], longest_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs of ``x`` with equal ``key`` (sorted by it) that keep the budgets of the chain from ``start``, and
    the places whose run of equal keys is too long for that."""
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(begins, len(x)))
    ring = [masks[(start + i) % len(masks)] for i in range(len(masks))]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    short = np.repeat(lengths <= longest_run, lengths)
    for off in range(1, int(lengths[lengths <= longest_run].max(initial=1))):
        a = np.flatnonzero(short[:-off] & (key[:-off] == key[off:]))
        if not len(a):
            break
        b, covered = a + off, 0
        for l, mask in enumerate(ring, 1):
            covered |= mask
            near = np.bitwise_count((x[a] ^ x[b]) & U64(covered)) <= l * radius // len(ring)
            a, b = a[near], b[near]
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right), np.flatnonzero(~short)


def chain_links(x: np.ndarray, start: int, radius: int, masks: list[int], longest_run: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs among distinct fingerprints ``x`` whose chain starts at segment ``start``.

    ``x`` must be sorted by that segment. All pairs of short runs are found. Long runs are split by the next
    segment of the ring: the chain's budget leaves it one differing bit, so linked pairs agree in it but for
    some bit, each of which is left out in turn. What stays crowded lies within the last segments of a dense
    ball; there enough pairs to connect whatever is linked are found through midpoints.
    """
    a, b, crowd = near_pairs(x, x & U64(masks[start]), start, radius, masks, longest_run)
    left, right = [a], [b]
    following = masks[(start + 1) % len(masks)]
    for bit in (U64(1 << i) for i in range(64) if following >> i & 1 and len(crowd)):
        key = x[crowd] & U64(masks[start] | following) & ~bit
        order = np.argsort(key, kind="stable")
        own = crowd[order]
        a, b, dense = near_pairs(x[own], key[order], start, radius, masks, longest_run)
        left.append(own[a])
        right.append(own[b])
        for run in np.split(dense, np.flatnonzero(key[order][dense][1:] != key[order][dense][:-1]) + 1) if len(dense) else ():
            free = [i for i in range(64) if 1 << i == int(bit) or not (masks[start] | following) >> i & 1]
            a, b = midpoint_links(x[own[run]], free, radius)
            left.append(own[run[a]])
            right.append(own[run[b]])
    return np.concatenate(left), np.concatenate(right)


def midpoint_links(x: np.ndarray, free: list[int], radius: int, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all distinct ``x`` within ``radius`` bits (1 or 2) of each other in the ``free`` bits.

    Two fingerprints differ in at most two bits just if flipping at most one bit of each can make them
    equal. Flipped forms are dealt into slices by hash, sorted, and equal neighbours are linked. With 22 free
    bits there are at most 2 ** 22 fingerprints, so the slices stay few.
    """
    if radius not in (1, 2):
        raise ValueError("long runs are linked for a radius of 1 or 2")
    own = np.arange(len(x))
    flips = [U64(0), *(U64(1 << i) for i in free)]
    slices = -(-len(x) * len(flips) // at_once)
    left, right = [], []
    for part in range(slices):
        forms, owner = [], []
        for flip in flips:
            z = x ^ flip
            mine = own if slices == 1 else np.flatnonzero(textvec.mix(z) % U64(slices) == U64(part))
            forms.append(z[mine])
            owner.append(mine)
        z, owner = np.concatenate(forms), np.concatenate(owner)
        order = np.argsort(z, kind="stable")
        z, owner = z[order], owner[order]
        same = z[1:] == z[:-1]
        a, b = owner[:-1][same], owner[1:][same]
        if radius == 1:
            near = np.bitwise_count(x[a] ^ x[b]) <= 1
            a, b = a[near], b[near]
        a, b = forest(len(x), a, b)
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of n nodes that isn't the smallest of its component, and that smallest."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(n))
    return rest, root[rest]


def links(prints: DataFrame, radius: int = 2, group_rows: int = 50_000) -> DataFrame:
    """a, b: enough linked pairs of the distinct fingerprints ``fp`` to connect all that link.

    Each fingerprint goes once to the group of each of its segments' values, as eight bytes. ``radius``: 1 or 2,
    as crowded groups are linked through midpoints.
    """
    if radius not in (1, 2):
        raise ValueError("fingerprints are linked within a radius of 1 or 2")
    masks = segment_masks(radius)
    spark = prints.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() * len(masks) // group_rows))
    keys = F.array(*(F.struct(F.lit(i).alias("chain"), F.pmod(F.xxhash64(F.col("fp").bitwiseAND(F.lit(np.uint64(m).astype(np.int64).item()))), F.lit(parts)).cast("int").alias("part")) for i, m in enumerate(masks)))
    rows = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.chain", "k.part")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        chain = key[0].as_py()
        x = group.column("fp").to_numpy().view(U64)
        x = x[np.argsort(x & U64(masks[chain]), kind="stable")]
        a, b = forest(len(x), *chain_links(x, chain, radius, masks))
        return pa.table({"a": x[a].view(np.int64), "b": x[b].view(np.int64)})

    return rows.groupBy("chain", "part").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) of every row."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    scratch = Scratch(docs.sparkSession)
    prints = scratch.cut(fingerprint(docs, size))
    nodes = scratch.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = connected_components(links(nodes, radius), scratch)
    # both sides have one row a fingerprint; copies join last
    members = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = members.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = members.join(smallest, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def united(classes: DataFrame, alike: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, component_id of rows linked by either of doc_id, component_id and doc_id, root.

    Both kinds of classes are named by a member, so only pairs of names have to be connected, not rows.
    """
    rows = classes.select("doc_id", "fp", "component_id").join(alike.select("doc_id", "root").distinct(), "doc_id", "left")
    rows = scratch.cut(rows.select("doc_id", "component_id", "root"))
    found = scratch.cut(connected_components(rows.select(F.col("component_id").alias("a"), F.col("root").alias("b")), scratch))
    joined = rows.select("doc_id", "component_id").join(found.withColumnsRenamed({"node": "component_id", "component": "_root"}), "component_id", "left")
    return joined.select("doc_id", F.coalesce("_root", "component_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 3, radius: int = 2, similarity: float | None = 0.8) -> DataFrame:
    """One row of each component, with all columns: one with the smallest doc_id.

    Fingerprints within two bits miss most near copies, so texts whose five-word shingles are alike to
    ``similarity`` (None: off) are linked besides: of such a group, too, only the smallest doc_id stays.

    Rows without an id can't be told apart: if some component holds only such rows, one of each fingerprint
    among them stays. Of rows that share the kept id the first by content stays. Only ids travel for the
    choice; of the texts only those travel whose ids a filter can't tell from ids that go.
    """
    scratch = Scratch(docs.sparkSession)
    classes = near_duplicates(docs, size, radius)
    if similarity is not None:
        classes = united(classes, similar(docs, threshold=similarity), scratch)
    classes = scratch.cut(classes.select("doc_id", "component_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = classes.where(stays).select(F.col("doc_id").alias("__kept")).distinct()
    repeated = classes.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id")
    doubtful = scratch.cut(classes.where(~stays).select("doc_id").unionByName(repeated))
    maybe, sure = Members.of(doubtful, F.xxhash64("doc_id"), scratch).split(docs, F.xxhash64("doc_id"))
    left = maybe.join(kept, maybe["doc_id"].eqNullSafe(F.col("__kept")), "left_semi")
    repeated = scratch.cut(repeated.select(F.col("doc_id").alias("__kept")))
    if repeated.isEmpty():
        return sure.unionByName(left)
    left = scratch.cut(left)
    again = left.join(repeated, left["doc_id"].eqNullSafe(F.col("__kept")), "left_semi")
    once = left.join(repeated, left["doc_id"].eqNullSafe(F.col("__kept")), "left_anti")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = F.min_by(row, F.to_json(row)).alias("__row")  # JSON only orders; the row itself is handed on
    chosen = again.where("doc_id is not null").groupBy("doc_id").agg(first)
    nameless = with_fingerprint(again.where("doc_id is null"), size, "__fp").groupBy("__fp").agg(first)
    return sure.unionByName(once).unionByName(chosen.select("__row.*")).unionByName(nameless.select("__row.*"))


def with_fingerprint(rows: DataFrame, size: int, name: str) -> DataFrame:
    """All columns, and the fingerprint of ``text`` under ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.portions(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch.append_column(name, pa.array(fingerprints_of(texts, size).view(np.int64)))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, LongType())]))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
