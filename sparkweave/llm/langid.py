"""Language identification: n-gram filters whose cells hold a bitmask of languages.

One Bloom filter per language, stored bit-sliced: a cell holds one bit for each language, so that the
AND of an n-gram's cells returns all languages that contain it at once. A text's n-grams are counted per
language (popcount of the language's bit); the count is corrected for the filter's false positive rate,
which differs by language with how full its slice is. The greatest corrected count decides, and its share
of all of them is the score.

An n-gram belongs to a language if the share of the language's documents that hold it is at least
``least_ratio`` of the greatest such share: words borrowed now and then don't enter a filter.

Fitted on a bounded sample of labelled rows (``max_train_rows``, chosen by a hash of doc_id; of each
language a tenth of an even share at least, if it has so many).

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a very long text is read whole.
A text none of whose n-grams is known, and ties, go to the language with most documents, then the smaller
name. Without labelled rows every text is ``und``. Repeated rows and null ids are judged row by row; a null
id is not held out. An empty table gives no rows. Columns other than id, text and language are not read, so
clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import textvec
from sparkweave.llm.common import pick, sampled, table

SIZES = (3, 4)
_STEPS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


class Letters:
    """Whether code points are letters; the table grows with the greatest code point asked for."""

    def __init__(self):
        self.table = np.zeros(0, bool)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        top = int(codes.max(initial=0)) + 1
        if top > len(self.table):
            size = min(0x110000, 1 << max(12, top.bit_length()))
            self.table = np.fromiter((chr(i).isalpha() for i in range(size)), bool, size)
        return self.table[codes]


def letter_text(texts: list[str], is_letter: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters with one space between words and around each text; starts; whether there is a letter."""
    codes, starts = textvec.code_points([f" {t.lower()} " for t in texts])
    letter = is_letter(codes)
    space = ~letter
    keep = letter | np.concatenate([[True], letter[:-1]])  # the first of several spaces
    keep[starts[:-1]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    found = textvec.sums_by_text(letter, starts) > 0
    return np.where(space, np.uint32(32), codes)[keep], total[starts], found


@dataclass
class LanguageFilters:
    """``cells``: for each word of 64 languages, the bitmask of every cell."""

    languages: list[str]
    cells: np.ndarray
    bits: int
    hashes: int
    false_rate: np.ndarray
    prior: np.ndarray

    @classmethod
    def build(cls, languages: list[str], documents: np.ndarray, grams: list[np.ndarray], bits: int, hashes: int) -> LanguageFilters:
        cells = np.zeros((-(-max(1, len(languages)) // 64), 1 << bits), np.uint64)
        for i, known in enumerate(grams):
            for j in range(hashes):
                at = textvec.distinct(_cell(known, j, bits))
                cells[i // 64, at] |= np.uint64(1 << (i % 64))
        fill = [float(((cells[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
        return cls(languages, cells, bits, hashes, np.array(fill) ** hashes, documents)

    def counts(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and how many of them each language holds, corrected."""
        n, hits = np.zeros(len(starts) - 1), np.zeros((len(starts) - 1, len(self.languages)))
        for size in SIZES:
            h = textvec.char_ngrams(codes, size, 32)
            n += np.maximum(0, np.diff(starts) - size + 1)
            for w, cells in enumerate(self.cells):
                mask = cells[_cell(h, 0, self.bits)]
                for j in range(1, self.hashes):
                    mask &= cells[_cell(h, j, self.bits)]
                ends = np.minimum(np.maximum(starts[1:] - size + 1, starts[:-1]), len(h))  # no n-gram across texts
                for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                    total = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)).astype(np.uint8) & np.uint8(1), dtype=np.int32)])
                    hits[:, i] += total[ends] - total[np.minimum(starts[:-1], len(h))]
        return n, np.maximum(0, (hits - n[:, None] * self.false_rate) / (1 - np.minimum(self.false_rate, 0.99)))

    def predict(self, codes: np.ndarray, starts: np.ndarray, has_letter: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * (len(starts) - 1), np.zeros(len(starts) - 1)
        _, hits = self.counts(codes, starts)
        order = sorted(range(len(self.languages)), key=lambda i: (-self.prior[i], self.languages[i]))
        best = np.array(order)[hits[:, order].argmax(1)]
        score = np.take_along_axis(hits, best[:, None], 1)[:, 0] / np.maximum(hits.sum(1), 1e-9)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, has_letter)], np.where(has_letter, score, 0.0)


def _cell(h: np.ndarray, j: int, bits: int) -> np.ndarray:
    return (h * _STEPS[j]) >> np.uint32(32 - bits)


def fit(docs: DataFrame, max_train_rows: int = 6000, least_ratio: float = 0.5, least_docs: int = 2, bits: int = 20, hashes: int = 3, tasks: int = 8) -> LanguageFilters:
    """From text, lang (not null) and doc_id. The sample goes to ``tasks`` tasks, each of which sends a row a language."""
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    total = sum(counts.values())
    if total > max_train_rows:
        least, wanted = max(1, max_train_rows // (10 * len(counts))), F.lit(False)
        for lang, n in counts.items():
            wanted = wanted | ((F.col("lang") == lang) & sampled(F.col("doc_id"), max(max_train_rows * n // total, min(n, least)), n))
        docs = docs.where(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = Letters()
        seen: dict[str, list[np.ndarray]] = {}
        docs_of: dict[str, int] = {}
        for batch in textvec.portions(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                codes, _, _ = letter_text([text or ""], is_letter)
                own = textvec.distinct(np.concatenate([textvec.char_ngrams(codes[:-1], n, 32) for n in SIZES]))
                seen.setdefault(lang, []).append(own)
                docs_of[lang] = docs_of.get(lang, 0) + 1
        for lang, parts in seen.items():
            every = np.sort(np.concatenate(parts))
            at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            counts = np.diff(np.append(at, len(every))).astype("<u4")
            yield pa.RecordBatch.from_pydict({"lang": [lang], "docs": [docs_of[lang]], "grams": [every[at].astype("<u4").tobytes()], "counts": [counts.tobytes()]})

    rows = docs.select("text", "lang").repartition(tasks).mapInArrow(count, "lang string, docs bigint, grams binary, counts binary").collect()
    languages = sorted({r["lang"] for r in rows})
    if counts and not languages:
        raise ValueError(f"none of {total} rows with a language was drawn")
    documents = np.array([sum(r["docs"] for r in rows if r["lang"] == x) for x in languages], float)
    all_grams = textvec.distinct(np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(r["grams"], "<u4") for r in rows)]))
    held = np.zeros((len(languages), len(all_grams)))
    for r in rows:
        i = languages.index(r["lang"])
        held[i, np.searchsorted(all_grams, np.frombuffer(r["grams"], "<u4"))] += np.frombuffer(r["counts"], "<u4")
    rate = held / np.maximum(1, documents)[:, None]
    most = rate.max(0, initial=0)
    # a language with few documents can't show an n-gram twice
    least = np.minimum(least_docs, np.maximum(1, documents // 5))[:, None]
    grams = [all_grams[k] for k in (rate >= least_ratio * most) & (held >= least)]
    return LanguageFilters.build(languages, documents, grams, bits, hashes)


def identify_language(docs: DataFrame, held_out: F.Column | None = None, max_train_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; rows where ``held_out`` is true teach nothing."""
    docs = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    aside = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    filters = fit(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~aside), max_train_rows)
    # plain values travel, so that reading them needs no class of this package
    model = docs.sparkSession.sparkContext.broadcast(tuple(getattr(filters, f.name) for f in fields(filters)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, is_letter = LanguageFilters(*model.value), Letters()
        for batch in textvec.portions(batches):
            names, scores = [], []
            for _, group in textvec.groups([t or "" for t in batch.column("text").to_pylist()]):
                name, score = filters.predict(*letter_text(group, is_letter))
                names += name
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", aside.alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
