"""Files table to graph tables: source parsers run per file, templates are plain column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.paths import MAX_SOURCE_BYTES, SOURCE_SUFFIXES, app_of, file_name, in_skipped_dir, is_lockfile, is_minified, language, suffix, template_name
from sparkweave.operators.graph import Graph, last_wins, linked, make_edges, merge_nodes
from sparkweave.operators.scratch import Scratch
from sparkweave.operators.stitch import contexts_by_prefix
from sparkweave.schema import edge_id
from sparkweave.sources import frontend_source, python_source

RAW = "path string, kind string, id string, type string, name string, qualified_name string, line int, src string, dst string, confidence double, extra string, at int"
FUNCTIONS = "path string, name string, start int, end int, complexity int"


def source_files(files: DataFrame) -> DataFrame:
    """Files that hold code (path, content): by directory, name, suffix and size."""
    path, name = F.col("path"), file_name(F.col("path"))
    keep = ~in_skipped_dir(path) & ~is_minified(name) & ~is_lockfile(name) & suffix(path).isin(*SOURCE_SUFFIXES) & (F.octet_length("content") <= MAX_SOURCE_BYTES)
    return files.where(keep)


def files_table(files: DataFrame) -> DataFrame:
    """path, hash, language."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), language(F.col("path")).alias("language"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RAW.split(", ")]
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RAW.split(", ")])
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            parse = python_source.extract if path.endswith(".py") else frontend_source.extract
            rows += [(path, *r, at) for at, r in enumerate(parse(path, content or ""))]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _dealt(files: DataFrame) -> DataFrame:
    """Files dealt among tasks: parsing costs far more than reading, and a few read splits can hold very many files."""
    spark = files.sparkSession
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "path")


def extract_sources(files: DataFrame) -> DataFrame:
    """Raw rows of Python, TypeScript and JavaScript files (path, content as text)."""
    return _dealt(files.where(F.col("path").rlike(r"(?i)\.(py|tsx?|jsx?)$")).select("path", "content")).mapInArrow(_rows, RAW)


def extract_templates(files: DataFrame) -> DataFrame:
    """Raw rows of HTML templates: the template, URL names, what it extends or includes, and calls of its attributes."""
    html = files.where(F.col("path").rlike(r"(?i)\.html?$")).select("path", "content", template_name(F.col("path")).alias("t"))
    me = F.concat(F.lit("django.template:"), "t")
    null = F.lit(None)

    def found(pattern: str, group: int = 1):
        return F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), group)))

    def node(rows, id, kind, name, qualified, extra=null):
        return rows.select("path", F.lit("node").alias("kind"), id.alias("id"), F.lit(kind).alias("type"), name.alias("name"), qualified.alias("qualified_name"), F.lit(1).alias("line"), null.cast("string").alias("src"), null.cast("string").alias("dst"), null.cast("double").alias("confidence"), extra.cast("string").alias("extra"), F.lit(0).alias("at"))

    def edge(rows, src, kind, dst):
        return rows.select("path", F.lit("edge").alias("kind"), edge_id(src, F.lit(kind), dst).alias("id"), F.lit(kind).alias("type"), null.cast("string").alias("name"), null.cast("string").alias("qualified_name"), null.cast("int").alias("line"), src.alias("src"), dst.alias("dst"), F.lit(0.9).alias("confidence"), null.cast("string").alias("extra"), F.lit(0).alias("at"))

    urls = html.select("path", "t", found(r"\{%\s*url\s+['\"]([^'\"]+)['\"]").alias("x"))
    parents = html.select("path", "t", found(r"\{%\s*(?:extends|include)\s+['\"]([^'\"]+)['\"]").alias("x"))
    calls = html.select("path", "t", found(r"hx-(get|post|put|patch|delete)=['\"][^'\"]+['\"]", 0).alias("x"))
    calls = calls.select("path", "t", F.upper(F.regexp_extract("x", r"hx-(\w+)", 1)).alias("method"), F.regexp_extract("x", r"=['\"]([^'\"]+)", 1).alias("url"))
    call = F.concat("path", F.lit(":"), "method", F.lit(" "), "url")
    call_id = F.concat(F.lit("django.htmx:"), call)
    parts = [
        node(html, me, "django.template", F.col("t"), F.col("t")),
        edge(urls, me, "calls", F.concat(F.lit("django.url_name:"), "x")),
        edge(parents, me, "renders", F.concat(F.lit("django.template:"), "x")),
        node(calls, call_id, "django.htmx", F.concat("method", F.lit(" "), "url"), call, F.to_json(F.struct(F.col("url").alias("raw")))),
        edge(calls, me, "htmx_calls", call_id),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def extract(files: DataFrame) -> DataFrame:
    files = source_files(files)
    return extract_sources(files).unionByName(extract_templates(files))


def to_graph(raw: DataFrame, contexts: DataFrame | None = None, ui_paths: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """Graph and residuals of raw rows; edges without both ends go.

    The rows are written out first: several branches read them, each of which would parse all files again.
    """
    raw = Scratch(raw.sparkSession).cut(raw)
    nodes, edges, residuals = folded(raw, contexts, ui_paths)
    # the ids that nodes merge under, without merging them
    ids = raw.where("kind = 'node'").select("id").distinct()
    return Graph(nodes, linked(edges, ids)), residuals


def folded(raw: DataFrame, contexts: DataFrame | None = None, ui_paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and residuals of raw rows. Versions of a node merge in the order of files and lines.

    ``contexts``: app, context; gives nodes of an app in Python files their context. ``ui_paths``: prefix, context, pos;
    gives nodes of other files theirs, by the first prefix of whole directories. Each id follows from its own rows alone.
    """
    extras = F.from_json("extra", "map<string,string>")
    n = raw.where("kind = 'node'").withColumn("app", F.get_json_object("extra", "$.app"))
    n = n.withColumn("referenced", F.get_json_object("extra", "$.referenced").cast("boolean"))
    placed, python = F.col("type").rlike(r"^(django|react|fastapi|graphql)\."), F.col("path").endswith(".py")
    n = n.join(contexts.withColumnRenamed("context", "app_context"), "app", "left") if contexts is not None else n.withColumn("app_context", F.lit(None).cast("string"))
    if ui_paths is not None:
        shown = contexts_by_prefix(n.where(~python).select("path").distinct(), ui_paths).withColumnRenamed("context", "ui_context")
        n = n.join(shown, "path", "left")
    else:
        n = n.withColumn("ui_context", F.lit(None).cast("string"))
    n = n.withColumn("context", F.when(placed, F.when(python, F.col("app_context")).otherwise(F.col("ui_context"))))
    keyed = n.select("id", "type", "name", "qualified_name", F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.lit(None).cast("int").alias("end_line"), "context", "referenced", "extra", F.struct("path", F.coalesce("line", F.lit(0)).alias("at"), "extra").alias("seq"))
    merged = merge_nodes(keyed, ["extra"])
    # extra values merge key by key: the last non-null one by the same order
    pairs = n.select("id", F.struct("path", F.coalesce("line", F.lit(0)).alias("at"), "extra").alias("seq"), F.explode(F.map_entries(extras)).alias("e"))
    values = pairs.groupBy("id", F.col("e.key").alias("key")).agg(F.max_by("e.value", "seq").alias("value"))
    # values that are JSON stay JSON; others become strings
    shown = F.when(F.col("value").rlike(r"^(\[|\{|true$|false$|-?\d+(\.\d+)?$)"), F.col("value")).otherwise(F.to_json(F.array("value")).substr(F.lit(2), F.length(F.to_json(F.array("value"))) - 2))
    whole = values.select("id", F.concat(F.lit('"'), "key", F.lit('":'), shown).alias("pair")).groupBy("id").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("pair")), ","), F.lit("}")).alias("extra"))
    nodes = merged.drop("extra").join(whole, "id", "left").select("id", "type", "name", "qualified_name", "file_path", "start_line", "end_line", "context", "extra")
    # of an edge's versions the last counts, by file and place in it
    e = last_wins(raw.where("kind = 'edge'").select("src", "dst", "type", F.struct("path", "at").alias("seq"), "confidence", "extra"), ["src", "dst", "type"], "seq")
    return nodes, make_edges(e), raw.where("kind = 'residual'").select("path", F.col("name").alias("what"), "line")


def functions_table(files: DataFrame) -> DataFrame:
    """path, name, start, end, complexity of every Python function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in python_source.functions(p, c or "")]
            names = [x.split()[0] for x in FUNCTIONS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i < 2 else pa.int32()) for i in range(5)], names)

    return _dealt(files.where(F.col("path").endswith(".py")).select("path", "content")).mapInArrow(run, FUNCTIONS)


def apps_of(files: DataFrame) -> DataFrame:
    return files.select("path", app_of(F.col("path")).alias("app"))
