"""Packing token sequences: sum-of-squares packing.

Documents are turned into token ids and cut into pieces no longer than a sequence. Pieces are placed one
by one where the sum, over all gaps, of the squared number of open sequences with that gap becomes
smallest; a full sequence is closed. Opening a sequence is weighed like any other place, as long as fewer
are open or full than the shard's tokens need at least; beyond that, which is known as all pieces of a shard
are, one is opened only where no open one has room. Full-length pieces make a sequence of their own.

The pieces, counted once they are cut, are dealt evenly into shards of about ``shard_rows`` pieces, each
packed by one task: its memory depends on the shard only, and a shard leaves only a few sequences open.
Within a shard the longest pieces come first.

Defined cases: a null text is the empty text, one end token. A very long text becomes many pieces, which any
shards take. Repeated rows are packed each; null ids do no harm. Of equally good places the one with the
smallest gap is taken, an open sequence before a new one. An empty table gives no rows. Columns other than
the id and the text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import textvec
from sparkweave.llm.common import pick, table
from sparkweave.operators.scratch import Scratch

#: Characters on which the two tokenizer libraries split alike by their fixed Unicode properties.
_COMMON = re.compile("[\x00-\x1b\x20-\x84\x86-ɏ]*")
#: Runs of white space from which on the fast library's split, which backtracks over them, may run out of stack.
_LONG_SPACE = re.compile(r"(?<!\s)\s{1000}")


def byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: how the byte-level pre-tokenizer of the library splits texts.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def has_merge_ranks(spec: dict) -> bool:
    """Whether a tokenizer file splits texts by the byte-level rule alone, and numbers tokens in the order of its merges."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True) and not spec.get("normalizer")
    if not plain or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    letters = byte_letters()
    return set(letters) <= set(model["vocab"]) and max(model["vocab"][c] for c in letters) < 256 and [model["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged)))


class Encoder:
    """Token ids by a byte-level BPE file of the library ``tokenizers``.

    Texts of common characters go through the same vocabulary as merge ranks, several times as fast and
    with the same ids; all others, and those with a long run of white space, go through ``tokenizers`` itself. So do all texts where the file doesn't
    say the one thing that the fast way can do: the plain byte-level split, and ids in the order of merges.
    """

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full, self.fast = Tokenizer.from_str(spec), None
        model = json.loads(spec)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        if has_merge_ranks(model):
            letters = byte_letters()
            ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast and _COMMON.fullmatch(text) and not _LONG_SPACE.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian 32-bit) of every piece of every row.

    ``tokenizer_path`` is read on the driver; the vocabulary, a few MB whatever the data, is sent along.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec.value)
        end = np.array([end_id], "<u4")
        for batch in textvec.portions(batches):
            rows, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                tokens = np.concatenate([encoder.ids(text.as_py() or ""), end])
                n = -(-len(tokens) // capacity)
                cuts = [0, *range(len(tokens) - (n - 1) * capacity, len(tokens) + 1, capacity)]
                rows += [i] * n
                piece += range(n)
                start += cuts[:-1]
                length += [b - a for a, b in zip(cuts, cuts[1:])]
                ids += [tokens[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it of each item, placed in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; none has gap 0
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bin_of, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    needed, none = -(-int(lengths.sum()) // capacity), np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        if s >= capacity:
            bin_of[i], offset[i], made = made, 0, made + 1
            continue
        # change of the sum by each gap from s on; a bin that becomes full leaves the sum
        change = np.where(count[s:capacity] > 0, 2 * (count[: capacity - s] - count[s:capacity]) + 2, none)
        if count[s]:
            change[0] -= 1
        gap = s + int(change.argmin())
        opening = 2 * count[capacity - s] + 1 if made < needed else none
        if count[gap] and change[gap - s] <= opening:
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            b, gap, made = made, capacity, made + 1
        bin_of[i], offset[i] = b, capacity - gap
        if gap > s:
            bins[gap - s].append(b)
            count[gap - s] += 1
    return bin_of, offset


def pack(pieces: DataFrame, capacity: int = 1024, shard_rows: int = 100_000) -> DataFrame:
    """All columns of ``pieces`` (with length), sequence_id and offset. ``pieces`` is read twice, so it should be a written table."""
    shards = max(1, -(-pieces.count() // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        every = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if every is None:
            return
        lengths = every.column("length").to_numpy()
        order = np.argsort(-lengths, kind="stable")
        bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        bin_of[order], offset[order] = sum_of_squares(lengths[order], capacity)
        bin_of += TaskContext.get().partitionId() << 40
        yield from every.append_column("sequence_id", pa.array(bin_of)).append_column("offset", pa.array(offset)).to_batches(max_chunksize=65536)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.repartition(shards).mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (little-endian 32-bit) of whole sequences, from packed pieces with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, shard_rows: int = 100_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = tokenize(docs, tokenizer_path, capacity, end_id)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(Scratch(docs.sparkSession).cut(digests), capacity, shard_rows)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
