"""Texts alike by their word shingles: links by the Jaccard similarity of whole sets, without a cap.

Texts with one set of shingles are one node. Three exact filters come before any pair is compared:

1. of two alike texts the heads (so many of the smallest hashes) share many hashes, so nodes whose heads share
   too few with all others drop out;
2. of the rest, shingles are put in one order, rarest first, and two alike texts have a common one among the
   first few of both (prefix filter);
3. the sizes, and the places at which a common shingle stands, bound what two texts can share.

Hashes travel to blocks by their value, packed with a list of their nodes, and come back packed by node.
Of hashes that many nodes of one task have, the task settles what it can itself, so that a shingle in a
great share of all texts costs a block a bounded number of rows a task.

Nodes meet under their keys in steps, and only those that earlier steps left in different groups: first each
meets one node of the key, which links large groups of copies by a row a node and key; then the nodes of
small buckets of a key meet, dealt anew in each round, which links what is alike in places; what is in
different groups still meets as a whole. No pair is compared twice. Exact but for equal 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm import textvec
from sparkweave.llm.members import Members
from sparkweave.operators.components import connected_components
from sparkweave.operators.scratch import Scratch

U64 = np.uint64
#: From this number of nodes on shingles count as equally frequent.
MOST_FREQUENT = 255
BLOCKS = "block int, nodes binary, sizes binary, counts binary, hashes binary, settled binary, told binary"
PARTS = "part int, told binary"
_SHARED = np.dtype([("node", "<i8"), ("shared", "<u4")])
_TOKEN = np.dtype([("node", "<i8"), ("token", "<u8"), ("n", "<u4"), ("c", "u1")])


def sets_of(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text's lower-cased (A-Z) words, sorted; shorter texts are one shingle."""
    words = textvec.Words([t.lower() for t in texts])
    h, whole = words.windows(size)
    h, owner = h[whole], words.text[: len(h)][whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        h, owner = h[first], owner[first]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = [h[a:b] for a, b in zip(cuts, cuts[1:])]
    for i in np.flatnonzero((words.counts > 0) & (words.counts < size)):
        out[i] = np.array([xxhash.xxh64_intdigest(b" ".join(words.lists[i]), 5)], U64)
    return out


def set_id(h: np.ndarray) -> int:
    """Name of a set of shingles (signed 64 bits)."""
    return xxhash.xxh64_intdigest(h.tobytes(), 5) - (1 << 63)


def each_set(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    for _, group in textvec.groups([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]):
        yield from sets_of(group, size)


def least_shared(n: int, threshold: float) -> int:
    """Shingles that a text with n of them has in common with any text alike to it; such a text has so many itself, too."""
    return math.ceil(threshold * n - 1e-9)


def more_shared(n: int) -> int:
    """How many shared hashes heads promise (of the smaller text's n)."""
    return n // 5 + 1


def head_length(n: int, threshold: float) -> int:
    """Of n hashes at most n - least_shared are not in the other text. Of two heads the one that ends first has
    more_shared hashes of the other text, all of them within the other head."""
    return n - least_shared(n, threshold) + more_shared(n)


def named(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, node, n (its shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.portions(batches):
            sets = list(each_set(batch, size))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([set_id(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64())], ["doc_id", "node", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node bigint, n bigint")


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of runs in which all columns stay the same."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    changes = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
    at = np.flatnonzero(changes)
    return at, np.diff(np.append(at, len(changes)))


class Dealer:
    """Hashes of one task's nodes, until they are sent to blocks.

    ``enough``: a hash that so many nodes here have is settled here: these nodes are told at once, and only the
    hash goes on, so that others learn of it.
    """

    def __init__(self, blocks: int, enough: int, narrow: bool, tell, at_once: int = 2_000_000):
        self.blocks, self.enough, self.tell, self.at_once = blocks, enough, tell, at_once
        self.kind = "<u4" if narrow else "<u8"
        self.clear()

    def clear(self):
        self.nodes, self.sizes, self.lists, self.held, self.seen = [], [], [], 0, set()

    def add(self, node: int, n: int, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if node not in self.seen and len(hashes):
            self.seen.add(node)
            self.nodes.append(node)
            self.sizes.append(n)
            self.lists.append(hashes)
            self.held += len(hashes)
            if self.held >= self.at_once:
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        h = np.concatenate([np.zeros(0, U64), *self.lists])
        owner = np.repeat(np.arange(len(self.lists)), np.fromiter(map(len, self.lists), np.int64, len(self.lists)))
        nodes, sizes = np.array(self.nodes, "<i8"), np.array(self.sizes, "<u4")
        mark = self.nodes[0] if self.nodes else 0  # some row brings along what is told here, not always the same block's
        self.clear()
        order = np.argsort(h, kind="stable")
        at, n = runs(h[order])
        often = np.zeros(len(h), bool)
        often[order] = np.repeat(n >= self.enough, n)
        settled = h[order][at[n >= self.enough]]
        told = self.tell(nodes[owner[often]], h[often], sizes[owner[often]]).tobytes()
        h, owner = h[~often], owner[~often]
        block, settled_in = ((textvec.mix(x) % U64(self.blocks)).astype(np.int64) for x in (h, settled))
        order = np.argsort(block, kind="stable")
        h, owner, block = h[order], owner[order], block[order]
        columns = {c.split()[0]: [] for c in BLOCKS.split(", ")}
        every = np.union1d(block, settled_in)
        starts, ends = np.searchsorted(block, every), np.searchsorted(block, every, "right")
        for i, (b, a, z) in enumerate(zip(every.tolist(), starts.tolist(), ends.tolist())):
            first, counts = runs(owner[a:z])
            of = owner[a:z][first]
            row = (b, nodes[of], sizes[of], counts.astype("<u4"), self.code(h[a:z]), self.code(settled[settled_in == b]))
            for c, x in zip(columns.values(), row):
                c.append(x if isinstance(x, int) else x.tobytes())
            columns["told"].append(told if i == mark % len(every) else b"")
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "block" else pa.binary()) for k, v in columns.items()], list(columns))

    def code(self, h: np.ndarray) -> np.ndarray:
        """Narrow: the upper half, which the block doesn't follow from. Equal halves only let more nodes through."""
        return (h >> U64(32)).astype("<u4") if self.kind == "<u4" else h.astype("<u8")


def opened(group: pa.Table, kind: str) -> tuple[np.ndarray, ...]:
    """node, size, hash of all rows of a block; settled hashes."""
    columns = {}
    for name, dtype in (("nodes", "<i8"), ("sizes", "<u4"), ("counts", "<u4"), ("hashes", kind), ("settled", kind)):
        columns[name] = np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x, dtype) for x in group.column(name).to_pylist())])
    return np.repeat(columns["nodes"], columns["counts"]), np.repeat(columns["sizes"], columns["counts"]), columns["hashes"], columns["settled"]


def by_part(told: np.ndarray, group: pa.Table | None, parts: int) -> pa.Table:
    """What nodes are told here, and what the rows bring along, by the part of the node."""
    if group is not None:
        told = np.concatenate([told, *(np.frombuffer(x, told.dtype) for x in group.column("told").to_pylist())])
    part = (textvec.mix(told["node"].view(U64)) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at, n = runs(part[order])
    return pa.table({"part": pa.array(part[order[at]], pa.int32()), "told": pa.array([told[order[a : a + m]].tobytes() for a, m in zip(at.tolist(), n.tolist())], pa.binary())})


def shared_in_heads(docs: DataFrame, size: int, threshold: float, blocks: int) -> DataFrame:
    """node, shared: how many hashes of a node's head other nodes' heads have too (nodes without any are left out)."""

    def tell(node, h, n):
        own, count = np.unique(node, return_counts=True)
        out = np.empty(len(own), _SHARED)
        out["node"], out["shared"] = own, count
        return out

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(blocks, 2, True, tell)
        for batch in textvec.portions(batches):
            for h in each_set(batch, size):
                yield from dealer.add(set_id(h), len(h), h[: head_length(len(h), threshold)])
        yield dealer.flush()

    def count(group: pa.Table) -> pa.Table:
        node, _, h, settled = opened(group, "<u4")
        order = np.lexsort((node, h))
        node, h = node[order], h[order]
        at, _ = runs(h, node)  # copies of one node in several tasks
        node, h = node[at], h[at]
        at, n = runs(h)
        shared = np.repeat((n > 1) | np.isin(h[at], settled), n)
        return by_part(tell(node[shared], None, None), group, blocks)

    def total(group: pa.Table) -> pa.Table:
        told = np.concatenate([np.frombuffer(x, _SHARED) for x in group.column("told").to_pylist()])
        own, at = np.unique(told["node"], return_inverse=True)
        return pa.table({"node": pa.array(own, pa.int64()), "shared": pa.array(np.bincount(at, told["shared"], len(own)).astype(np.int64))})

    dealt = docs.select("text").mapInArrow(deal, BLOCKS)
    return dealt.groupBy("block").applyInArrow(count, PARTS).groupBy("part").applyInArrow(total, "node bigint, shared bigint")


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """node, n, hashes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.portions(batches, 128):
            sets = list(each_set(batch, size))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.astype("<u8").tobytes() for h in sets], pa.binary())], ["node", "n", "hashes"])

    return docs.select("text").mapInArrow(run, "node bigint, n bigint, hashes binary")


def keys_of(sets: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """node, n, token, place: the shingles by which nodes find all nodes alike to them.

    Shingles stand in one order for all, rarest first. Of two alike texts both have a common shingle among
    the first n - least_shared + 1; the ones of a single text find nothing and are left out. place: how
    many of the text's shingles stand before it.
    """

    def tell(node, h, n, c=None):
        out = np.empty(len(node), _TOKEN)
        out["node"], out["token"], out["n"], out["c"] = node, h, n, MOST_FREQUENT if c is None else c
        return out

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(blocks, MOST_FREQUENT, False, tell)
        for batch in textvec.portions(batches, 64):
            for node, n, h in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "hashes")), strict=True):
                yield from dealer.add(node, n, np.frombuffer(h, "<u8"))
        yield dealer.flush()

    def count(group: pa.Table) -> pa.Table:
        node, n, h, settled = opened(group, "<u8")
        order = np.argsort(h, kind="stable")
        node, n, h = node[order], n[order], h[order]
        at, c = runs(h)
        c = np.repeat(np.where(np.isin(h[at], settled), MOST_FREQUENT, np.minimum(c, MOST_FREQUENT)), c)
        return by_part(tell(node[c > 1], h[c > 1], n[c > 1], c[c > 1]), group, blocks)

    def first(group: pa.Table) -> pa.Table:
        told = np.concatenate([np.frombuffer(x, _TOKEN) for x in group.column("told").to_pylist()])
        told = told[np.lexsort((told["token"], told["c"], told["node"]))]
        at, m = runs(told["node"])
        n = told["n"][at].astype(np.int64)
        wanted = np.maximum(0, m - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)
        nth = np.arange(len(told)) - np.repeat(at, m)
        kept = nth < np.repeat(wanted, m)
        place = (nth + np.repeat(n - m, m))[kept]
        told = told[kept]
        columns = {"node": told["node"], "n": told["n"].astype(np.int64), "token": told["token"].view(np.int64), "place": place.astype(np.int64)}
        return pa.table({k: pa.array(np.ascontiguousarray(v), pa.int64()) for k, v in columns.items()})

    dealt = sets.mapInArrow(deal, BLOCKS)
    return dealt.groupBy("block").applyInArrow(count, PARTS).groupBy("part").applyInArrow(first, "node bigint, n bigint, token bigint, place bigint")


def likeness(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def alike(pairs: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs a, b whose whole sets have at least this Jaccard similarity. Only sets of such nodes travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [likeness(x, y) >= threshold for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = scratch.cut(pairs)
    sides = []
    for side, name in (("a", "x"), ("b", "y")):
        wanted, _ = Members.of(pairs.select(side).distinct(), F.col(side), scratch).split(sets, F.col("node"))
        sides.append(wanted.select(F.col("node").alias(side), F.col("hashes").alias(name)))
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def possible(threshold: float, x: str, y: str):
    """Whether two nodes that meet at these places can share enough."""
    n = F.col(f"{x}n") + F.col(f"{y}n")
    return F.least(F.col(f"{x}n") - F.col(f"{x}place"), F.col(f"{y}n") - F.col(f"{y}place")) >= F.ceil(F.lit(threshold / (1 + threshold)) * n - F.lit(1e-9))


def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select(*more, *(F.col(c).alias(name + c) for c in ("node", "n", "place", "group")))


def links_under_keys(keyed: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch, rounds: int = 2, bucket: int = 16) -> DataFrame:
    """a, b: alike nodes, enough to connect all that are."""
    counts = keyed.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    keyed = scratch.cut(keyed.join(counts, "token"))
    links = tested = None

    def grouped(rows: DataFrame) -> DataFrame:
        if links is None:
            return rows.withColumn("group", F.col("node"))
        found = scratch.cut(connected_components(links, scratch))
        return rows.join(found, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")

    def test(met: DataFrame) -> None:
        nonlocal links, tested
        met = met.where((F.col("xgroup") != F.col("ygroup")) & possible(threshold, "x", "y"))
        pairs = met.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()
        pairs = scratch.cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        good = scratch.cut(alike(pairs, sets, threshold, scratch))
        links = good if links is None else links.unionByName(good)

    def meeting(rows: DataFrame, *keys: str) -> DataFrame:
        return side(rows, "x", *keys).join(side(rows, "y", *keys), list(keys)).where("xnode < ynode")

    rows = grouped(keyed)
    one = F.min(F.struct(F.xxhash64("node", F.pmod("token", F.lit(8))), "node", "n", "place", "group")).alias("o")
    ones = rows.groupBy("token").agg(one).select("token", *(F.col(f"o.{c}").alias(f"y{c}") for c in ("node", "n", "place", "group")))
    test(side(rows, "x", "token").join(ones, "token"))
    for i in range(rounds):
        # keys of one bucket are done after the first round
        rows = grouped(keyed if i == 0 else keyed.where(F.col("c") > bucket))
        dealt = F.pmod(F.xxhash64("node", "token", F.lit(i)), F.ceil(F.col("c") / bucket))
        test(meeting(scratch.cut(rows.withColumn("bucket", dealt)), "token", "bucket"))
    test(meeting(scratch.cut(grouped(keyed.where(F.col("c") > bucket))), "token"))
    return links


def similar(docs: DataFrame, size: int = 5, threshold: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, root: rows whose texts are alike by word shingles (Jaccard similarity ``threshold``), directly
    or over others, have the same root, the smallest doc_id among them.

    Texts without words are one set and alike; null is the empty text; rows with a null id link like others.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    rows = scratch.cut(named(docs, size))
    nodes = scratch.cut(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n")))
    # the smaller of two alike texts has at least least_shared(n) shingles
    promised = F.floor(F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) / 5) + 1
    left = scratch.cut(nodes.join(shared_in_heads(docs, size, threshold, blocks), "node").where(F.col("shared") >= promised).select("node", "first"))
    # one row of each node that is left is read again; some others come along and do no harm
    again, _ = Members.of(left, F.xxhash64("first"), scratch).split(docs.select("doc_id", "text"), F.xxhash64("doc_id"))
    sets = scratch.cut(whole_sets(again, size).groupBy("node").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")))
    found = connected_components(links_under_keys(scratch.cut(keys_of(sets, threshold, blocks)), sets, threshold, scratch), scratch)
    # named by the smallest id
    members = nodes.join(found, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    roots = members.groupBy("component").agg(F.min("first").alias("root"))
    return rows.select("doc_id", "node").join(members.join(roots, "component").select("node", "root"), "node").select("doc_id", "root")
