"""Substring dedup by relative Lempel-Ziv parsing against reference blocks.

Every document is a reference for those with a greater id. The references' windows (``window`` words in a
row) are indexed in blocks: a window belongs to the block of its anchor, the smallest hash among the shorter
word n-grams in it, so equal windows always meet in the same block, and neighbouring windows, which mostly
share an anchor, travel as one stretch. A block's index leads from a window to the first place, by document,
that has it.

Each document's stretches are parsed greedily against the block: at each window the index gives the first
place; if its document is an earlier one, a factor (place, length) begins there and goes on while the next
window's place is the next one of that document. Where a factor ends, the next window is looked up anew, so
windows over the boundary of two factors are found in the index as well; those over the end of a stretch
belong to the next one. Factors of one document that continue each other are joined across blocks. A factor
covers at least ``window`` words.

The index compares windows by 64-bit hashes; words decide: each factor is sent to its source, whose words
there are digested (128 bits), and counts only if the document's own words have that digest. What proven
factors cover are the duplicate spans.

A task parses its own documents against each other first, so that of a passage in very many documents each
task sends one. Anchors that are too frequent for a block (all occurrences are counted, but for those that a
task has less than ``SELDOM`` times) hand their windows on one by one, each to the block of its own hash. Texts
travel once to prove factors and once to meet them, and only those whose ids a filter can't tell from ids
without any.

Defined cases: a null text has no words. Very long texts are parsed whole. Rows with a null id keep all words
and are no reference. Of rows with one id none is the earlier one; each row is judged by its own text, and
repeated rows alike. Of several earlier documents that tie, the smallest id is the source. An empty table
gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import textvec
from sparkweave.llm.common import pick, table
from sparkweave.llm.members import Members
from sparkweave.operators.scratch import Scratch

U32, U64 = np.uint32, np.uint64
ENTRY = "block int, ids binary, digests binary, entries binary, starts binary, sizes binary, hashes binary, told binary"
SPANS = "array<struct<start:int,end:int>>"
FACTORS = "array<struct<start:int,words:int,source:bigint,source_start:int>>"
#: ``n`` windows from ``start`` on in document ``id`` stand in document ``source`` from ``at`` on.
_FACTOR = np.dtype([("id", "<i8"), ("digest", "<u4"), ("start", "<u4"), ("n", "<u4"), ("source", "<i8"), ("text", "<u4"), ("at", "<u4")])
_WANTED = np.dtype([("nth", "<u4"), ("at", "<u4"), ("n", "<u4")])
_PROOF = np.dtype([("nth", "<u4"), ("proof", "S32")])
#: Occurrences of an anchor in a task's portion from which on they are counted.
SELDOM = 4
MOST_CROWDED = 1 << 17


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of the n values from each place."""
    done, out = 1, x
    while done < n:
        step = min(done, n - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of runs; ``breaks``: whether a new run starts at each place."""
    at = np.flatnonzero(breaks)
    return at, np.diff(np.append(at, len(breaks)))


def small(x: np.ndarray) -> bytes:
    """As numbers of one, two or four bytes, whichever all fit."""
    top = int(x.max(initial=0))
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def unsmall(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def first_places(keys: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each window: the number of the first one, by document and place, with the same key."""
    order = np.lexsort((starts, docs))
    order = order[np.argsort(keys[order], kind="stable")]
    out = np.empty(len(keys), np.int64)
    if len(keys):
        at, n = runs(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        out[order] = np.repeat(order[at], n)
    return out


def parse(keys: np.ndarray, docs: np.ndarray, starts: np.ndarray, ids: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors of windows in order (key, number of document, start in it; documents' ids and digests), and whether
    each window lies in one. Documents are numbered by id and digest."""
    first = first_places(keys, docs, starts)
    inside = ids[docs] > ids[docs[first]]
    hit = np.flatnonzero(inside)
    source = first[hit]
    goes_on = (docs[hit][1:] == docs[hit][:-1]) & (starts[hit][1:] == starts[hit][:-1] + 1)
    goes_on &= (docs[source][1:] == docs[source][:-1]) & (starts[source][1:] == starts[source][:-1] + 1)
    at, n = runs(np.concatenate([[True], ~goes_on])) if len(hit) else (np.zeros(0, np.int64),) * 2
    own, other = docs[hit[at]], docs[source[at]]
    out = np.empty(len(at), _FACTOR)
    out["id"], out["digest"], out["start"], out["n"] = ids[own], digests[own], starts[hit[at]], n
    out["source"], out["text"], out["at"] = ids[other], digests[other], starts[source[at]]
    return out, inside


class Stretches:
    """Texts of one task, until they are sent."""

    def __init__(self, window: int, gram: int, blocks: int, crowded: np.ndarray):
        self.window, self.gram, self.blocks, self.crowded = window, gram, blocks, crowded
        self.clear()

    def clear(self):
        self.parts, self.ids, self.digests, self.size = [], [], [], 0

    def add(self, ids: list[int], texts: list[bytes], digests: list[int]) -> None:
        words = textvec.Words(texts)
        h, whole = words.windows(self.window)
        grams, _ = words.windows(self.gram)
        at = np.flatnonzero(whole)
        anchor = sliding_min(grams, self.window - self.gram + 1)[at] if len(at) else np.zeros(0, U64)
        text = words.text[at]
        self.parts.append((h[at], anchor, text + len(self.ids), at - words.starts[text]))
        self.size += len(at)
        self.ids += ids
        self.digests += digests

    def flush(self) -> Iterator[dict]:
        """Rows for the blocks, with the factors found here."""
        if not self.size:
            return self.clear()
        h, anchor, doc, start = (np.concatenate(x) for x in zip(*self.parts))
        ids, digests = np.array(self.ids, np.int64), np.array(self.digests, U32)
        self.clear()
        by_id = np.lexsort((digests, ids))
        number = np.empty(len(ids), np.int64)
        number[by_id] = np.arange(len(ids))
        ids, digests, doc = ids[by_id], digests[by_id], number[doc]
        told, inside = parse(h, doc, start, ids, digests)
        h, anchor, doc, start = (x[~inside] for x in (h, anchor, doc, start))
        single = np.isin(anchor, self.crowded)
        follows = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1) & (anchor[1:] == anchor[:-1]) & ~single[1:]
        at, n = runs(np.concatenate([[True], ~follows])) if len(h) else (np.zeros(0, np.int64),) * 2
        at, n = _split(at, n, 255)
        block = (textvec.mix(np.where(single, h, anchor)[at]) % U64(self.blocks)).astype(np.int64)
        by_block = np.argsort(block, kind="stable")
        at, n, block = at[by_block], n[by_block], block[by_block]
        where, count = runs(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else (np.zeros(0, np.int64),) * 2
        mark = int(textvec.mix(ids[:1].view(U64))[0])  # some row brings the factors found here along, not always the same block's
        for i, (a, m) in enumerate(zip(where.tolist(), count.tolist())):
            own_at, own_n = at[a : a + m], n[a : a + m]
            of = doc[own_at]
            doc_at, doc_n = runs(np.concatenate([[True], of[1:] != of[:-1]]))
            yield {
                "block": int(block[a]), "ids": ids[of[doc_at]].tobytes(), "digests": digests[of[doc_at]].tobytes(), "entries": small(doc_n),
                "starts": small(start[own_at]), "sizes": small(own_n), "hashes": h[_expand(own_at, own_n)].tobytes(), "told": told.tobytes() if i == mark % len(where) else b"",
            }
        if not len(where) and len(told):
            yield dict.fromkeys(("ids", "digests", "entries", "starts", "sizes", "hashes"), b"") | {"block": mark % self.blocks, "told": told.tobytes()}


def _split(at: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut so that none is longer than ``most``."""
    if not len(n) or n.max() <= most:
        return at, n
    pieces = -(-n // most)
    i = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(i)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return at[i] + nth * most, np.minimum(most, n[i] - nth * most)


def _expand(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the runs."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def parse_block(rows: list[dict]) -> np.ndarray:
    """Factors of a block's stretches by its own index, and those that the rows bring along."""
    ids, digests, starts, sizes, keys = [], [], [], [], []
    for r in rows:
        per_doc = unsmall(r["entries"], len(r["ids"]) // 8)
        entries = int(per_doc.sum())
        ids.append(np.repeat(np.frombuffer(r["ids"], "<i8"), per_doc))
        digests.append(np.repeat(np.frombuffer(r["digests"], "<u4"), per_doc))
        starts.append(unsmall(r["starts"], entries))
        sizes.append(unsmall(r["sizes"], entries))
        keys.append(np.frombuffer(r["hashes"], "<u8"))
    ids, digests, starts, sizes, keys = (np.concatenate(x) for x in (ids, digests, starts, sizes, keys))
    order = np.lexsort((starts, digests, ids))  # stretches by document, which are numbered by id and digest
    offsets = (np.cumsum(sizes) - sizes)[order]
    ids, digests, starts, sizes = ids[order], digests[order], starts[order], sizes[order]
    at, n = runs(np.concatenate([[True], (ids[1:] != ids[:-1]) | (digests[1:] != digests[:-1])])) if len(ids) else (np.zeros(0, np.int64),) * 2
    docs = np.repeat(np.repeat(np.arange(len(at)), n), sizes)
    found, _ = parse(keys[_expand(offsets, sizes)], docs, _expand(starts, sizes), ids[at], digests[at])
    return np.concatenate([found, *(np.frombuffer(r["told"], _FACTOR) for r in rows)])


def dealt(found: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Factors by the part of their document."""
    part = (textvec.mix(found["id"].view(U64)) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at, n = runs(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(part) else (np.zeros(0, np.int64),) * 2
    for a, m in zip(at.tolist(), n.tolist()):
        yield int(part[order[a]]), found[order[a : a + m]].tobytes()


def by_document(payloads: list[bytes]) -> dict[str, object]:
    """id, digest and factors of each document; those that continue one another at the ends of stretches are one."""
    out = np.concatenate([np.zeros(0, _FACTOR), *(np.frombuffer(p, _FACTOR) for p in payloads)])
    out = out[np.lexsort((out["at"], out["text"], out["source"], out["n"], out["start"], out["digest"], out["id"]))]
    if len(out):
        out = out[np.concatenate([[True], out[1:] != out[:-1]])]  # of repeated rows
        same = lambda name, more=0: out[name][1:] == out[name][:-1] + more
        n = out["n"][:-1]
        at, count = runs(np.concatenate([[True], ~(same("id") & same("digest") & same("source") & same("text") & same("start", n) & same("at", n))]))
        joined = out[at].copy()
        joined["n"] = np.add.reduceat(out["n"], at)
        out = joined
    at, n = runs(np.concatenate([[True], (out["id"][1:] != out["id"][:-1]) | (out["digest"][1:] != out["digest"][:-1])])) if len(out) else (np.zeros(0, np.int64),) * 2
    return {"id": out["id"][at], "digest": out["digest"][at].astype(np.int64), "found": [out[a : a + m].tobytes() for a, m in zip(at.tolist(), n.tolist())]}


def proof(words: list[bytes], start: int, n: int) -> bytes:
    """Digest of ``n`` words from ``start`` on."""
    return hashlib.blake2b(b" ".join(words[start : start + n]), digest_size=16).hexdigest().encode()


def proven(found: DataFrame, docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """``found`` (id, digest, found) with ``proofs``: what the factors' sources (rows doc_id, of, text of ``docs``) have there."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, digest, own in zip(*(batch.column(c).to_pylist() for c in ("id", "digest", "found")), strict=True):
                own = np.frombuffer(own, _FACTOR)
                order = np.lexsort((own["text"], own["source"]))
                at, n = runs(np.concatenate([[True], (own["source"][order][1:] != own["source"][order][:-1]) | (own["text"][order][1:] != own["text"][order][:-1])]))
                for a, m in zip(at.tolist(), n.tolist()):
                    of = order[a : a + m]
                    wanted = np.empty(m, _WANTED)
                    wanted["nth"], wanted["at"], wanted["n"] = of, own["at"][of], own["n"][of]
                    rows.append((int(own["source"][of[0]]), int(own["text"][of[0]]), id_, digest, wanted.tobytes()))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["source", "text_of", "id", "digest", "wanted"])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.portions(batches, 64):
            out = []
            for text, wanted in zip(batch.column("text").cast(pa.binary()), batch.column("wanted"), strict=True):
                words, asked = (text.as_py() or b"").split(), np.frombuffer(wanted.as_py(), _WANTED)
                told = np.empty(len(asked), _PROOF)
                told["nth"] = asked["nth"]
                told["proof"] = [proof(words, at, n + window - 1) for _, at, n in asked.tolist()]
                out.append(told.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(out, pa.binary())], ["id", "digest", "proofs"])

    asked = scratch.cut(found.mapInArrow(ask, "source bigint, text_of bigint, id bigint, digest bigint, wanted binary"))
    sources, _ = Members.of(asked.select("source").distinct(), F.xxhash64("source"), scratch).split(docs, F.xxhash64("doc_id"))
    sources = sources.select(F.col("doc_id").alias("source"), F.col("of").alias("text_of"), "text")
    proofs = asked.join(sources, ["source", "text_of"]).select("id", "digest", "text", "wanted").mapInArrow(prove, "id bigint, digest bigint, proofs binary")
    return found.join(proofs.groupBy("id", "digest").agg(F.collect_list("proofs").alias("proofs")), ["id", "digest"])


def checked(found: bytes | None, proofs: list[bytes] | None, words: list[bytes], window: int) -> np.ndarray:
    """The factors whose words are those of their source."""
    found = np.frombuffer(found or b"", _FACTOR)
    told = {nth: p for part in proofs or () for nth, p in np.frombuffer(part, _PROOF).tolist()}
    return found[[told.get(i) == proof(words, a, n + window - 1) for i, (a, n) in enumerate(found[["start", "n"]].tolist())]] if len(found) else found


def covered(found: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word spans that factors cover; found by ascending start."""
    spans: list[tuple[int, int]] = []
    for start, n in zip(found["start"].tolist(), found["n"].tolist()):
        end = start + n - 1 + window
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
    return spans


def crowded_anchors(docs: DataFrame, window: int, gram: int, most: int, at_once: int = 1_000_000) -> np.ndarray:
    """Anchors with over ``most`` stretches, sorted; the ``MOST_CROWDED`` commonest at most, so they may be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send() -> pa.RecordBatch:
            anchor, n = np.unique(np.concatenate([np.zeros(0, U64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(anchor[n >= SELDOM].view(np.int64)), pa.array(n[n >= SELDOM])], ["anchor", "n"])

        held, size = [], 0
        for batch in textvec.portions(batches):
            for _, group in textvec.groups(batch.column("text").cast(pa.binary()).to_pylist()):
                words = textvec.Words(group)
                _, whole = words.windows(window)
                if whole.any():
                    anchor = sliding_min(words.windows(gram)[0], window - gram + 1)[whole]
                    held.append(anchor[np.concatenate([[True], anchor[1:] != anchor[:-1]])])
                    size += len(anchor)
                if size >= at_once:
                    yield send()
                    held, size = [], 0
        yield send()

    counts = docs.where("doc_id is not null and text is not null").select("text").mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > most).orderBy(F.desc("n"), "anchor").limit(MOST_CROWDED).toArrow()
    return np.sort(rows.column("anchor").to_numpy().view(U64))


def dedupe_substrings(docs: DataFrame, window: int = 13, gram: int = 4, block_bytes: int = 4 << 20, task_windows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (removed words, end exclusive), factors (where they come from) and kept (the other words, joined by a space) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 8)
    digest = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    # a stretch has some five windows of some six bytes a word: an anchor may fill an eighth of a block
    crowded = spark.sparkContext.broadcast(crowded_anchors(docs, window, gram, max(200, total // blocks // 240)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stretches(window, gram, blocks, crowded.value)
        names = [x.split()[0] for x in ENTRY.split(", ")]
        schema = pa.schema([(n, pa.int32() if n == "block" else pa.binary()) for n in names])
        for batch in textvec.portions(batches):
            ids, digests = batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()
            for at, group in textvec.groups(batch.column("text").cast(pa.binary()).to_pylist()):
                held.add(ids[at : at + len(group)], group, digests[at : at + len(group)])
                if held.size >= task_windows:
                    yield pa.RecordBatch.from_pylist(list(held.flush()), schema)
        yield pa.RecordBatch.from_pylist(list(held.flush()), schema)

    def parsed(group: pa.Table) -> pa.Table:
        rows = list(dealt(parse_block(group.to_pylist()), parts))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "found": pa.array([r[1] for r in rows], pa.binary())})

    def collect(group: pa.Table) -> pa.Table:
        out = by_document(group.column("found").to_pylist())
        return pa.table({"id": pa.array(out["id"], pa.int64()), "digest": pa.array(out["digest"], pa.int64()), "found": pa.array(out["found"], pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.struct([(x, pa.int64() if x == "source" else pa.int32()) for x in names])) for names in (("start", "end"), ("start", "words", "source", "source_start"))]
        for batch in textvec.portions(batches):
            counts, spans, sources, kept = [], [], [], []
            for text, own_found, proofs in zip(batch.column("text").cast(pa.binary()), batch.column("found"), batch.column("proofs"), strict=True):
                words = (text.as_py() or b"").split()
                counts.append(len(words))
                found = checked(own_found.as_py(), proofs.as_py(), words, window)
                own = covered(found, window)
                spans.append([{"start": a, "end": b} for a, b in own])
                sources.append([{"start": r[0], "words": r[1] + window - 1, "source": r[2], "source_start": r[3]} for r in found[["start", "n", "source", "at"]].tolist()])
                last, rest = 0, []
                for a, b in own:
                    rest += words[last:a]
                    last = b
                kept.append(b" ".join(rest + words[last:] if own else words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, kinds[0]), pa.array(sources, kinds[1]), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "spans", "factors", "kept"])

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text", digest.alias("digest")).mapInArrow(index, ENTRY)
    # factors of a document come from many blocks: they travel in bulk by parts of the ids, not one by one
    found = rows.groupBy("block").applyInArrow(parsed, "part int, found binary")
    found = scratch.cut(found.groupBy("part").applyInArrow(collect, "id bigint, digest bigint, found binary"))
    docs = docs.withColumn("of", digest)
    found = scratch.cut(proven(found, docs, window, scratch))
    some, others = Members.of(found.select("id").distinct(), F.xxhash64("id"), scratch).split(docs, F.xxhash64("doc_id"))
    joined = some.join(found, (F.col("doc_id") == F.col("id")) & (F.col("of") == F.col("digest")), "left").select("doc_id", "text", "found", "proofs")
    every = joined.unionByName(others.select("doc_id", "text", F.lit(None).cast("binary").alias("found"), F.lit(None).cast("array<binary>").alias("proofs")))
    return every.mapInArrow(cut, f"doc_id bigint, n_words bigint, spans {SPANS}, factors {FACTORS}, kept string")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedupe_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)
), f AS (
  SELECT g, min(doc_id) AS first FROM g GROUP BY g
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT g.doc_id, g.i FROM g JOIN f ON g.g = f.g WHERE f.first < g.doc_id)
), x AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w
), k AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p WHERE c.p IS NULL GROUP BY x.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
