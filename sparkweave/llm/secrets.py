"""Secret scans over an incremental ledger of blobs.

Every version of a text is a *blob*, addressed by the SHA-256 of its content. A ledger table records
which rules, by version, have scanned which blob and what each version found. ``update`` scans only pairs
of blob and rule version that the ledger lacks; ``findings`` joins what the current versions found, and
nothing that others did, back to all paths (rows) that hold the blob.

Defined cases: a null text is the empty text; a very long text is scanned whole. Rows with equal texts share
one scan, whatever their id, a null id included. Repeated rows each get their findings. Spans with one start
stand in the order of the rules. An empty table gives no rows. Columns other than the id and the text are not
read by a scan; masking hands them on, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import textvec
from sparkweave.llm.common import materialize, pick, shared_dir, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` count if ``group`` has ``least`` characters or more.

    ``hints``: no match is possible in a text that has none of these characters or strings.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    ignore_case: bool = False
    hints: tuple[str, ...] = ()
    revision: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}@{self.revision}"

    def find(self, compiled: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
        if self.hints and not any(h in text for h in self.hints):
            return
        for m in compiled.finditer(text):
            a, b = m.span(self.group)
            if b - a >= self.least:
                yield m.span()


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, group=2, ignore_case=True, hints=(":", "=")),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hints=("AKIA",)),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: What the ledger looks for besides: key blocks, signed web tokens and prefixed service tokens.
MORE_RULES = (
    # through the END line; without one, through the lines of the key
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*-----END [A-Z ]*PRIVATE KEY-----|(?:\s*[A-Za-z0-9+/=]{16,})*)", 20, hints=("-----BEGIN ",), revision=2),
    # from the start of a run of token characters: a run of very many "eyJ" is tried once
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30, hints=("eyJ",), revision=2),
    Rule("prefixed", r"(?:ghp|gho|ghs|glpat|sk_live|xoxb|xoxp)[_-][A-Za-z0-9-]{16,}", 20, hints=("ghp_", "gho_", "ghs_", "glpat-", "sk_live", "xoxb", "xoxp")),
)
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
#: What the ledger keeps of a span.
FOUND = "array<struct<start:bigint,end:bigint,kind:string,version:string>>"
LEDGER = f"blob binary, versions array<string>, spans {FOUND}"


def scan_text(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[dict]:
    """Spans of all rules in a whole text."""
    return [{"start": a, "end": b, "kind": rule.kind, "version": rule.version} for rule, compiled in rules for a, b in rule.find(compiled, text)]


def _compiled(rule: Rule) -> re.Pattern:
    # runs of one class: the shortest accepted length goes into the pattern, which skips short runs quickly
    pattern = f"{rule.pattern[:-1]}{{{rule.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) else rule.pattern
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {rule.version: (rule, _compiled(rule)) for rule in rules}
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("version", pa.string())]))
        for batch in textvec.portions(batches):
            todo = batch.column("versions").to_pylist()
            spans = [scan_text(text.as_py(), [ready[v] for v in versions]) for text, versions in zip(batch.column("text"), todo, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("versions"), pa.array(spans, kind)], ["blob", "versions", "spans"])

    return scan


class BlobLedger:
    """Ledger table of scanned blobs in folder ``path`` (rows: blob, versions, spans)."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def seen(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")
        except AnalysisException:
            return None

    def paths(self, docs: DataFrame) -> DataFrame:
        """doc_id, blob of every row; written once, as content addresses cost a pass over all texts."""
        return materialize(docs.select("doc_id", _address().alias("blob")), f"{shared_dir(self.spark)}/paths")

    def update(self, docs: DataFrame, paths: DataFrame) -> None:
        """Scan what the ledger lacks.

        One row per blob is elected by an aggregation over 32-byte addresses; texts travel once, by
        (doc_id, blob), so that a blob with very many copies doesn't meet in one task.
        """
        todo = paths.groupBy("blob").agg(F.min("doc_id").alias("elected"))
        wanted = F.array(*(F.lit(r.version) for r in self.rules))
        if (seen := self.seen()) is not None:
            done = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("done"))
            todo = todo.join(done, "blob", "left").withColumn("versions", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
            todo = todo.where(F.size("versions") > 0)
        else:
            todo = todo.withColumn("versions", wanted)
        todo = todo.select("elected", F.col("blob").alias("of"), "versions")
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _address().alias("blob"))
        texts = texts.join(todo, (F.col("blob") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("elected")))
        scanned = texts.select("blob", "text", "versions").mapInArrow(_scanner(self.rules), LEDGER)
        # a row may be there more than once
        scanned.groupBy("blob").agg(F.first("versions").alias("versions"), F.first("spans").alias("spans")).write.mode("append").parquet(f"{self.path}/ledger")

    def current(self) -> DataFrame:
        """blob, spans (by start, then by the rules' order) of the blobs in which current rule versions found something."""
        versions = [r.version for r in self.rules]
        rank = F.create_map(*(x for i, v in enumerate(versions) for x in (F.lit(v), F.lit(i))))
        found = self.seen().select("blob", F.filter("spans", lambda s: s["version"].isin(versions)).alias("spans")).where(F.size("spans") > 0)
        found = found.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
        shown = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[s["version"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
        return found.select("blob", F.array_sort(shown).alias("spans"))

    def findings(self, paths: DataFrame) -> DataFrame:
        """doc_id, blob, spans of every path."""
        # written out, so that the join's both sides are plain shuffles and a blob with very many paths can be split
        spans = materialize(self.current(), f"{shared_dir(self.spark)}/found")
        return paths.join(spans, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _address():
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def scan_secrets(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob, spans (start, rank, kind, end in code points) of every row of ``docs``."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id=id_col, text=text_col)
    ledger = BlobLedger(spark, ledger_path or f"{shared_dir(spark)}/secrets", rules)
    paths = ledger.paths(docs)
    ledger.update(docs, paths)
    return ledger.findings(paths)


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``docs`` (doc_id, text, maybe n_chars and more) with each stretch covered by spans replaced by ``mask``.

    Findings travel to the rows by content address, and only those of blobs that have any.
    """
    spark = docs.sparkSession
    slim = pick(docs, doc_id="doc_id", text="text")
    ledger = BlobLedger(spark, f"{shared_dir(spark)}/secrets", rules)
    ledger.update(slim, ledger.paths(slim))
    spans = materialize(ledger.current(), f"{shared_dir(spark)}/found").select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    joined = docs.withColumn("__of", _address()).join(spans, F.col("__of") == F.col("__blob"), "left").drop("__of", "__blob")
    names = joined.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.portions(batches):
            texts = [cover(t, s, mask) if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)]
            columns = {n: batch.column(n) for n in names if n != "__spans"}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                new = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                columns["n_chars"] = pa.compute.if_else(pa.compute.is_valid(batch.column("__spans")), new, columns["n_chars"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(run, docs.schema)


def cover(text: str | None, spans: list[dict], mask: str) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [(text or "")[at : s["start"]], mask]
        at = s["end"]
    return "".join([*out, (text or "")[at:]])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE_RULES]

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    digest = F.sha2(line(F.filter("spans", lambda s: s.kind.isin(base))), 256)
    return found.select("doc_id", *map(count, base), digest.alias("base_sha256"), line(F.col("spans")).alias("spans"))
