"""Queries over an index of rows that stand for files: following edits, generated clients, layouts, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions.urls import route_template
from sparkweave.operators import layout, rules, score
from sparkweave.operators.graph import Graph, make_edges
from sparkweave.operators.scratch import Scratch
from sparkweave.plans import stitching
from sparkweave.plans.lens import lens, read
from sparkweave.plans.live import LiveIndex
from sparkweave.plans.queries import ORACLES, query
from sparkweave.sources.extraction import RAW
from sparkweave.sources.store import Store
from sparkweave.sources.tree import Manifest, openapi_operations


def raw_nodes(rows: DataFrame, kind: str, id: str, name: str, extra) -> DataFrame:
    """Raw rows of nodes of one type: path, id, name and JSON extras."""
    value = {"path": F.col("path"), "kind": F.lit("node"), "id": F.concat(F.lit(f"{kind}:"), F.col(id)), "type": F.lit(kind), "name": F.col(name), "qualified_name": F.col(id), "line": F.lit(1), "extra": F.to_json(extra), "at": F.lit(0)}
    fields = [f.strip().split(" ") for f in RAW.split(",")]
    return rows.select(*(value.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))


#: Before: routes of suppliers, clients of customers. After: a route file and a client file are gone, three others name their parts anew.
GONE, RENAMED = ("r/3.py", "c/2.ts"), ("r/4.py", "r/5.py", "c/3.ts")


def _served(spark: SparkSession, sf: str, after: bool) -> DataFrame:
    letter = lambda: F.when(F.col("path").isin(*RENAMED) & F.lit(after), "t").otherwise("s")
    s = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    routes = s.withColumn("path", F.concat(F.lit("r/"), "s_nationkey", F.lit(".py")))
    routes = routes.withColumn("route", F.concat(F.lit("n"), "s_nationkey", F.lit("/"), letter(), "s_suppkey", F.lit("/<int:pk>/"))).withColumn("key", F.concat(F.lit("s"), "s_suppkey"))
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 100 + 1).alias("s_suppkey")).join(s, "s_suppkey")
    clients = c.withColumn("path", F.concat(F.lit("c/"), "c_nationkey", F.lit(".ts"))).withColumn("key", F.concat(F.lit("c"), "c_custkey"))
    mount = F.when(F.col("c_custkey") % 2 == 0, "/api/n").otherwise("/n")
    clients = clients.withColumn("url", F.concat(mount, "s_nationkey", F.lit("/"), letter(), "s_suppkey", F.lit("/${id}")))
    rows = raw_nodes(routes, "django.route", "key", "route", F.struct("route", F.lit("shop").alias("app"))).unionByName(
        raw_nodes(clients, "react.api_client", "key", "url", F.struct(F.col("url").alias("raw"), (F.col("c_custkey") % 7 == 0).alias("generated"))))
    return rows.where(~F.col("path").isin(*GONE)) if after else rows


def _hashes(raw: DataFrame) -> DataFrame:
    return raw.select("path", F.lit("").alias("hash"), F.lit("other").alias("language")).distinct()


def _edited(spark: SparkSession, sf: str) -> LiveIndex:
    before, after = _served(spark, sf, False), _served(spark, sf, True)
    live = LiveIndex(spark, Scratch(spark).path, parts=16).create_from(before, _hashes(before))
    paths = spark.createDataFrame([(p,) for p in (*GONE, *RENAMED)], "path string")
    fresh = after.where(F.col("path").isin(*RENAMED))
    live.apply(paths, fresh, _hashes(fresh))
    return live


_SERVED = """s AS (SELECT s_suppkey, s_nationkey FROM supplier),
r AS (SELECT 'django.route:s' || s_suppkey AS id, s_suppkey AS k, CASE WHEN s_nationkey IN (4, 5) THEN 't' ELSE 's' END AS letter FROM s WHERE s_nationkey <> 3),
c AS (SELECT 'react.api_client:c' || c_custkey AS id, s_suppkey AS k, CASE WHEN c_nationkey = 3 THEN 't' ELSE 's' END AS letter, c_custkey % 2 AS odd, c_custkey % 7 = 0 AS generated
  FROM customer JOIN s ON s_suppkey = c_custkey % 100 + 1 WHERE c_nationkey <> 2),
better AS (SELECT DISTINCT k, letter, odd FROM c WHERE generated)"""


@query(f"""WITH {_SERVED} SELECT r.id AS src, c.id AS dst, CAST(CASE WHEN generated THEN 0.95 WHEN better.k IS NOT NULL THEN 0.4 ELSE 0.55 END AS DOUBLE) AS confidence
FROM c JOIN r ON r.k = c.k AND r.letter = c.letter LEFT JOIN better ON better.k = c.k AND better.letter = c.letter AND better.odd = c.odd""")
def live_stitching(spark, sf):
    """Stitched edges of an index that followed edits: files gone, routes and clients renamed."""
    return _edited(spark, sf).graph().edges.where("type = 'consumed_by_client'").select("src", "dst", "confidence")


@query(f"""WITH {_SERVED} SELECT CASE WHEN r.id IS NULL THEN 'no route' WHEN better.k IS NULL THEN 'no generated client' ELSE 'superseded' END AS kind, count(*) AS n
FROM c LEFT JOIN r ON r.k = c.k AND r.letter = c.letter LEFT JOIN better ON better.k = c.k AND better.letter = c.letter AND better.odd = c.odd
WHERE r.id IS NULL AND c.odd = 0 OR r.id IS NOT NULL AND NOT c.generated GROUP BY 1""")
def live_residuals(spark, sf):
    """What stays open in that index, by kind."""
    what = F.when(F.col("what").startswith("no route"), "no route").when(F.col("what").contains("no generated"), "no generated client").otherwise("superseded")
    return _edited(spark, sf).residuals().groupBy(what.alias("kind")).agg(F.count("*").alias("n"))


#: Globs of generated clients, as rows.
GLOBS = ("c/1*.ts", "**/gen/c?.{ts,js}", "c/[56].ts")


@query("""WITH f AS (SELECT c_custkey, 'c/' || c_nationkey || '.ts' AS path, '/api/p' || c_custkey % 40 AS template FROM customer),
g AS (SELECT *, path LIKE 'c/1%.ts' OR regexp_matches(path, '^c/[56]\\.ts$') AS generated FROM f)
SELECT 'react.api_client:' || c_custkey AS client, generated, NOT generated AND template IN (SELECT template FROM g WHERE generated) AS superseded FROM g""")
def superseded_clients(spark, sf):
    """Clients in files that globs name as generated, and those that such a client of the same template supersedes."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit("c/"), "c_nationkey", F.lit(".ts")).alias("path"), F.concat(F.lit("/api/p"), F.col("c_custkey") % 40).alias("url"))
    nodes = raw_nodes(c, "react.api_client", "key", "url", F.struct(F.col("url").alias("raw"))).withColumnRenamed("path", "file_path")
    globs = Manifest(generated_clients=list(GLOBS)).globs(spark)
    return stitching.superseded(stitching.clients(nodes, globs)).select("client", "generated", "superseded")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '/a/{id}/b' || p_partkey WHEN 1 THEN '/{id}/c' || p_partkey WHEN 2 THEN '/{id}/{id}/d' ELSE '/e' || p_partkey || '(f|g)/{id}' END AS template FROM part""")
def nested_groups(spark, sf):
    """Routes whose named groups hold groups four deep, classes with brackets, and escaped ones."""
    k, n = F.col("p_partkey"), F.col("p_size") % 4
    route = F.when(n == 0, F.concat(F.lit("^a/(?P<x>[^/]+)/b"), k, F.lit("/$"))).when(n == 1, F.concat(F.lit("(?P<x>(?:(?:(?:a|b(c))d)e)+)/c"), k)).when(
        n == 2, r"(?P<x>[)(]+)/(?P<y>\)\()/d").otherwise(F.concat(F.lit("e"), k, F.lit(r"(f|g)/(?P<y>\d{4})")))
    return read(spark, sf, "part").select("p_partkey", route_template(route).alias("template"))


@query(f"SELECT rule, count(*) AS n FROM (SELECT 'cascade_crosses_context' AS rule FROM ({ORACLES['cascade_cross_context']})) GROUP BY 1")
def cached_findings(spark, sf):
    """Findings kept by version: the second time no rule runs."""
    def never():
        raise AssertionError("findings of this version are kept")

    kept, empty = Store(spark, Scratch(spark).path), spark.createDataFrame([], "app string, context string")
    kept.cached("findings", "v1", lambda: rules.cascades(lens(spark, sf), empty))
    return kept.cached("findings", "v1", never).groupBy("rule").agg(F.count("*").alias("n"))


#: Files of a project: apps by nation, UI features by segment, with what tells which directory is what.
_LAYOUT = """f AS (
  SELECT 'srv/n' || c_nationkey || '/' || CASE c_custkey % 3 WHEN 0 THEN 'models.py' WHEN 1 THEN 'views/list.py' ELSE 'util.py' END AS path FROM customer
  UNION SELECT 'web/src/features/' || lower(c_mktsegment) || '/' || 'C' || c_custkey % 5 || '.tsx' FROM customer UNION SELECT 'web/package.json' UNION SELECT 'srv/manage.py' UNION SELECT 'srv/n3/tests/x/manage.py')"""


@query(f"""WITH {_LAYOUT} SELECT kind, name, root FROM (
  SELECT 'app' AS kind, regexp_extract(path, '([^/]+)/models\\.py$', 1) AS name, regexp_extract(path, '^(.*)/models\\.py$', 1) AS root FROM f WHERE path LIKE '%/models.py'
  UNION SELECT 'feature', regexp_extract(path, '/features/([^/]+)/', 1), regexp_extract(path, '^(.*/features/[^/]+)/', 1) FROM f WHERE path LIKE '%/features/%'
  UNION SELECT 'root', 'backend', 'srv' UNION SELECT 'root', 'frontend', 'web/src')""")
def layout_parts(spark, sf):
    """Apps, UI features and the roots above them, inferred from paths."""
    c = read(spark, sf, "customer")
    app = F.concat(F.lit("srv/n"), "c_nationkey", F.lit("/"), F.when(F.col("c_custkey") % 3 == 0, "models.py").when(F.col("c_custkey") % 3 == 1, "views/list.py").otherwise("util.py"))
    ui = F.concat(F.lit("web/src/features/"), F.lower("c_mktsegment"), F.lit("/C"), F.col("c_custkey") % 5, F.lit(".tsx"))
    fixed = spark.createDataFrame([("web/package.json",), ("srv/manage.py",), ("srv/n3/tests/x/manage.py",)], "path string")
    files = c.select(F.explode(F.array(app, ui)).alias("path")).unionByName(fixed)
    return layout.layout(files).select("kind", "name", "root")


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 7 AS m, 'n' || p_partkey AS q, p_brand || '.py' AS f FROM part),
e AS (SELECT k, 'n' || k AS src, 'n' || (k + 1) AS dst, CASE WHEN k % 5 = 0 THEN 'tested_by' WHEN k % 5 < 3 THEN 'consumed_by_client' WHEN k % 5 = 3 THEN 'matches_schema' ELSE 'calls' END AS type, CASE k % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.55 ELSE 1.0 END AS c FROM p)
SELECT 'untested_receiver' AS kind, q AS node_id, 'no test: ' || q || ' ' || f AS what FROM p WHERE m = 0 AND k % 5 <> 0
UNION SELECT 'dynamic_serializer', q, 'serializer chosen at run time: ' || q FROM p WHERE m = 1
UNION SELECT 'string_reference', q, 'model named by a string: ' || q FROM p WHERE m = 2
UNION SELECT 'inferred_node', q, 'inferred: ' || q FROM p WHERE m IN (2, 3)
UNION SELECT 'queryset', q, 'queryset inside a serializer: ' || q FROM p WHERE m = 4
UNION SELECT 'nplusone', q, 'queries in a loop: a,z in ' || f || ':' || k FROM p WHERE m = 5
UNION SELECT 'overlap', dst, 'inferred from shared fields: ' || src || ' and ' || dst FROM e WHERE type = 'matches_schema' AND c < 0.8
UNION SELECT 'superseded', dst, 'a generated client covers ' || dst FROM e WHERE type = 'consumed_by_client' AND c = 0.4
UNION SELECT 'inferred_edge', dst, 'inferred: ' || type || ' ' || src || ' ' || dst FROM e WHERE type <> 'matches_schema' AND c < 0.8 AND c <> 0.4""")
def path_residuals(spark, sf):
    """What a walk can't vouch for, over parts as nodes of seven kinds and edges between neighbours."""
    k, m = F.col("p_partkey"), F.col("p_size") % 7
    p, name = read(spark, sf, "part"), F.concat(F.lit("n"), F.col("p_partkey"))
    hit = F.array(F.struct(k.cast("int").alias("line"), F.lit("x").alias("loop_var"), F.array(F.lit("z"), F.lit("a")).alias("accessed")))
    extras = F.to_json(F.struct(
        F.when(m == 1, True).alias("get_serializer_class"), F.when(m == 2, True).alias("string_ref"), F.when(m.isin(2, 3), True).alias("inferred"), F.when(m == 4, True).alias("queryset_in_serializer"), F.when(m == 5, hit).alias("nplusone")))
    nodes = p.select(name.alias("id"), F.when(m == 0, "django.receiver").otherwise("django.view").alias("type"), name.alias("name"), name.alias("qualified_name"), F.concat("p_brand", F.lit(".py")).alias("file_path"), extras.alias("extra"))
    kind = F.when(k % 5 == 0, "tested_by").when(k % 5 < 3, "consumed_by_client").when(k % 5 == 3, "matches_schema").otherwise("calls")
    sure = F.when(k % 4 == 0, 0.4).when(k % 4 == 1, 0.55).otherwise(1.0)
    edges = p.select(name.alias("src"), F.concat(F.lit("n"), k + 1).alias("dst"), kind.alias("type"), sure.alias("confidence"))
    return score.path_residuals(Graph(nodes, make_edges(edges)))


@query("""SELECT '/n' || s_nationkey || '/s' || s_suppkey || '/{id}' AS path, m AS method, CASE WHEN m = 'GET' THEN 'read_' || s_suppkey END AS operation FROM supplier, (SELECT unnest(['GET', 'POST']) AS m)
UNION SELECT '/n' || s_nationkey || '/all', 'DELETE', 'drop_' || s_nationkey FROM supplier""")
def described_operations(spark, sf):
    """Operations of API descriptions: a nation's suppliers in YAML blocks, and what all have in JSON."""
    s = read(spark, sf, "supplier")
    block = F.concat(F.lit("  /n"), "s_nationkey", F.lit("/s"), "s_suppkey", F.lit("/{pk}/:\n    get:\n      tags: [a]\n      operationId: read_"), "s_suppkey", F.lit("\n    post:\n      responses: {}\n"))
    yaml = s.select("s_nationkey", block.alias("block")).groupBy("s_nationkey").agg(F.concat(F.lit("openapi: 3.0.3\npaths:\n"), F.array_join(F.collect_list("block"), "")).alias("content")).select("content")
    text = F.concat(F.lit('{"paths": {"/n'), "s_nationkey", F.lit('/all/": {"delete": {"operationId": "drop_'), "s_nationkey", F.lit('"}}}}'))
    return openapi_operations(spark, yaml.unionByName(s.select(text.alias("content")).distinct()))
