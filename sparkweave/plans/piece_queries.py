"""Queries of single operators over rows of the driver's tables that stand for files, routes, reviews or tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import paths as P
from sparkweave.functions import urls as U
from sparkweave.operators import evolution, graph, history, rules, score, stitch
from sparkweave.plans.lens import NODE_COLUMNS, lens, read
from sparkweave.plans.queries import _COMMITS, _in, commits, on_lens, query
from sparkweave.schema import SINK_TYPES
from sparkweave.sources import extraction


def _graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame | None = None) -> graph.Graph:
    """Graph of nodes with whichever of the node columns they have."""
    full = nodes.select("id", *((F.col(c) if c in nodes.columns else F.lit(None).cast("string")).alias(c) for c in NODE_COLUMNS))
    return graph.Graph(full, graph.make_edges(edges if edges is not None else spark.createDataFrame([], "src string, dst string, type string")))


# --- files --------------------------------------------------------------------------------------------

_DIRS = ("src", "env", "node_modules", "docs", "src/.cache", "media")
_NAMES = ("a.py", "b.min.js", "c.bundle.js", "d.d.ts", "package-lock.json", "e.htm", "f.TSX", "g.txt", "h.graphql")
_FILES = f"f AS (SELECT p_partkey, p_name, {list(_DIRS)}[1 + p_size % 6] AS dir, {list(_NAMES)}[1 + p_partkey % 9] AS name FROM part), p AS (SELECT *, dir || '/p' || p_partkey || '/' || name AS path FROM f)"


def _tree(spark, sf) -> DataFrame:
    """A file for each part, in directories and under names of all kinds."""
    def pick(values, at):
        return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))

    path = F.concat(pick(_DIRS, F.col("p_size") % 6), F.lit("/p"), "p_partkey", F.lit("/"), pick(_NAMES, F.col("p_partkey") % 9))
    return read(spark, sf, "part").select(path.alias("path"), F.col("p_name").alias("content"))


@query(f"WITH {_FILES} SELECT path FROM p WHERE dir IN ('src', 'env', 'media') AND name IN ('a.py', 'e.htm', 'f.TSX', 'h.graphql')")
def source_files(spark, sf):
    return extraction.source_files(_tree(spark, sf)).select("path")


@query(f"WITH {_FILES} SELECT path, dir IN ('node_modules', 'docs', 'src/.cache') AS skipped, name IN ('b.min.js', 'c.bundle.js', 'd.d.ts') AS minified, name = 'package-lock.json' AS lockfile, dir = 'node_modules' OR name IN ('b.min.js', 'package-lock.json') AS skippable FROM p")
def skipped_paths(spark, sf):
    path, name = F.col("path"), P.file_name(F.col("path"))
    return _tree(spark, sf).select("path", P.in_skipped_dir(path).alias("skipped"), P.is_minified(name).alias("minified"), P.is_lockfile(name).alias("lockfile"), P.is_skippable(path).alias("skippable"))


@query(f"WITH {_FILES} SELECT path, sha256(p_name) AS hash, CASE WHEN name = 'a.py' THEN 'python' WHEN name IN ('f.TSX', 'd.d.ts') THEN 'typescript' WHEN name IN ('b.min.js', 'c.bundle.js') THEN 'javascript' WHEN name = 'e.htm' THEN 'html' WHEN name = 'h.graphql' THEN 'graphql' ELSE 'other' END AS language FROM p")
def file_hashes(spark, sf):
    return extraction.files_table(_tree(spark, sf))


@query("SELECT event_type AS kind, min(event_id) AS first FROM events GROUP BY 1")
def first_seen(spark, sf):
    return graph.first_seen(read(spark, sf, "events").withColumnRenamed("event_type", "kind"), "kind", "event_id")


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, 'the ', '***'), 'the%20', '***'), '\b(gh[pousr]_|glpat-|github_pat_)[A-Za-z0-9_-]{8,}', '\1***', 'g'), '(bearer|token)\s+[A-Za-z0-9._-]{12,}', '\1 ***', 'gi'), '://[^/\s:@]+:[^/\s@]+@', '://***@', 'g')) AS masked FROM documents")
def redacted_texts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(P.redact(F.col("text"), "the ")).alias("masked"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN '****' ELSE '****' || right(c_name, 4) END AS shown, CASE WHEN length(c_mktsegment) <= 8 THEN '****' ELSE '****' || right(c_mktsegment, 4) END AS segment FROM customer")
def masked_values(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", P.mask(F.col("c_name")).alias("shown"), P.mask(F.col("c_mktsegment")).alias("segment"))


# --- routes -------------------------------------------------------------------------------------------


@query("""WITH inc AS (SELECT p_brand, min_by(p_size, p_partkey) AS first FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT p_partkey, CASE WHEN first IS NOT NULL THEN '/api/v' || first || '/p/{id}/f' || p_size END AS mounted_at FROM part LEFT JOIN inc USING (p_brand)""")
def mounted_routes(spark, sf):
    p = read(spark, sf, "part")
    routes = p.select("p_partkey", F.col("p_brand").alias("app"), F.concat(F.lit("^p/<int:pk>/f"), "p_size", F.lit("/$")).alias("path"))
    includes = p.where("p_size % 2 = 0").select(F.col("p_brand").alias("app"), F.concat(F.lit("api/v"), "p_size", F.lit("/")).alias("prefix"), F.col("p_partkey").alias("pos"))
    return stitch.apply_includes(routes, includes).select("p_partkey", "mounted_at")


@query("SELECT p_partkey, '/api/p' || p_size || '/{id}' AS based, 'GET' AS method, '/x/{id}/' || p_size AS api, CASE WHEN p_size % 2 = 0 THEN '{id}' ELSE 's' || p_size END AS segment, CASE WHEN p_size % 3 = 0 THEN '/m' WHEN p_size % 3 = 1 THEN '/full' ELSE 'declared' END AS published, p_size % 2 = 0 AS belongs FROM part")
def url_pieces(spark, sf):
    n = F.col("p_size")
    method, api = U.public_api(F.concat(F.lit("get /x/<int:pk>/"), n, F.lit("/")))
    segment = U.dynamic_segment(F.when(n % 2 == 0, "[id]").otherwise(F.concat(F.lit("s"), n)))
    published = U.published_route(F.when(n % 3 == 0, "/m").otherwise(""), F.when(n % 3 == 1, "/full"), F.lit("declared"))
    belongs = U.path_belongs(F.concat(F.lit("/o"), n % 2, F.lit("/:id/x")), F.lit("/o0/<int:pk>/"))
    return read(spark, sf, "part").select("p_partkey", U.join_base(F.lit("https://h.test/api/"), F.concat(F.lit("/p"), n, F.lit("/:id"))).alias("based"), method.alias("method"), api.alias("api"), segment.alias("segment"), published.alias("published"), belongs.alias("belongs"))


@query("SELECT c_custkey AS client, n_name AS server FROM customer JOIN nation ON n_nationkey = CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE (c_nationkey + 1) % 25 END WHERE n_nationkey < 20")
def graphql_match(spark, sf):
    """A third of the clients is named as the server's operation, the others select it."""
    named = F.col("c_custkey") % 3 == 0
    c = read(spark, sf, "customer")
    clients = c.select(F.col("c_custkey").alias("client"), F.when(named, F.concat(F.lit("GetN"), "c_nationkey")).otherwise("Page").alias("name"), F.array(F.lit("zzz"), F.when(~named, F.concat(F.lit("getN"), (F.col("c_nationkey") + 1) % 25)).otherwise("yyy")).alias("selections"))
    servers = read(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_name").alias("server"), F.concat(F.lit("getn"), "n_nationkey").alias("name"))
    return stitch.match_graphql(clients, servers)


@query("SELECT s_suppkey AS call, min(n_name) AS route FROM supplier JOIN nation ON n_nationkey % 10 = s_nationkey % 10 GROUP BY 1")
def suffix_match(spark, sf):
    """Calls by the end of a route's path; a few routes end alike."""
    calls = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("call"), F.concat(F.lit("/s"), F.col("s_nationkey") % 10, F.lit("/list/")).alias("url"))
    routes = read(spark, sf, "nation").select(F.col("n_name").alias("route"), F.concat(F.lit("shop/<int:pk>/s"), F.col("n_nationkey") % 10, F.lit("/list")).alias("path"))
    return stitch.match_suffix(calls, routes)


@query("SELECT o_orderkey AS client, o_orderstatus AS route, TRUE AS exact FROM orders")
def visited_routes(spark, sf):
    """Pages that browser tests visit, and the routes behind them."""
    o = read(spark, sf, "orders")
    visits = o.select(F.col("o_orderkey").alias("client"), U.e2e_template(F.concat(F.lit("https://shop.test/st"), "o_orderstatus", F.lit("/"), "o_orderkey", F.lit("/?tab=1"))).alias("url"))
    routes = o.select(F.col("o_orderstatus").alias("route"), F.concat(F.lit("st"), "o_orderstatus", F.lit("/<int:pk>/")).alias("path")).distinct()
    return stitch.match_routes(visits, routes)


@query("SELECT n_nationkey, min('/r/' || c_custkey) AS local_path FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 2 = 0 GROUP BY 1")
def local_clones(spark, sf):
    repos = read(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("Org/"), F.col("n_nationkey")).alias("slug"))
    clones = read(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("oRG/"), "c_nationkey").alias("slug"), F.concat(F.lit("/r/"), "c_custkey").alias("path"))
    return stitch.attach_clones(repos, clones).select("n_nationkey", "local_path")


# --- rules and scores ---------------------------------------------------------------------------------

_REGIONS = "SELECT c_custkey, r.r_name AS own, o.r_name AS other, '/a' || o.r_regionkey || '/x' || c_custkey AS url FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region r ON r.r_regionkey = n_regionkey JOIN region o ON o.r_regionkey = c_custkey % 5"


@query(f"SELECT 'react.hook:' || c_custkey AS node_id, url AS subject, other AS other_context FROM ({_REGIONS}) WHERE own <> other")
def foreign_api_calls(spark, sf):
    region = read(spark, sf, "region")
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    url = F.concat(F.lit("/a"), F.col("c_custkey") % 5, F.lit("/x"), "c_custkey")
    hook, client = F.concat(F.lit("react.hook:"), "c_custkey"), F.concat(F.lit("react.api_client:"), url)
    hooks = c.select(hook.alias("id"), F.lit("react.hook").alias("type"), F.col("r_name").alias("context"))
    clients = c.select(client.alias("id"), F.lit("react.api_client").alias("type"), url.alias("name"))
    g = _graph(spark, hooks.unionByName(clients, True), c.select(hook.alias("src"), client.alias("dst"), F.lit("calls").alias("type")))
    apis = region.select(F.col("r_name").alias("context"), F.concat(F.lit("/a"), "r_regionkey").alias("path"), F.col("r_regionkey").alias("pos"))
    return rules.foreign_apis(g, apis).select("node_id", "subject", "other_context")


@query("SELECT 'django.serializer:' || s_suppkey AS node_id, s_name AS subject FROM supplier WHERE s_nationkey % 4 = 1")
def queryset_in_serializer(spark, sf):
    extra = F.to_json(F.struct((F.col("s_nationkey") % 4 == 1).alias("queryset_in_serializer")))
    nodes = read(spark, sf, "supplier").select(F.concat(F.lit("django.serializer:"), "s_suppkey").alias("id"), F.lit("django.serializer").alias("type"), F.col("s_name").alias("name"), extra.alias("extra"))
    return rules.queryset_in_serializer(_graph(spark, nodes)).select("node_id", "subject")


@query("SELECT 'django.task:' || o_orderkey AS node_id, 't' || o_orderkey AS subject FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 3 <> 0")
def task_idempotency(spark, sf):
    """Tasks of finished orders take a key, every third takes nothing."""
    args = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("order")))
    extra = F.to_json(F.struct(args.alias("args"), (F.col("o_orderstatus") == "F").alias("looks_idempotent_on_pk")))
    nodes = read(spark, sf, "orders").select(F.concat(F.lit("django.task:"), "o_orderkey").alias("id"), F.lit("django.task").alias("type"), F.concat(F.lit("t"), "o_orderkey").alias("name"), extra.alias("extra"))
    return rules.task_idempotency(_graph(spark, nodes)).select("node_id", "subject")


@query("SELECT 'django.view:' || c_custkey AS id, CASE WHEN c_nationkey % 5 = 0 THEN '' WHEN c_nationkey % 2 = 0 THEN array_to_string(list_sort(['Any', c_mktsegment]), ',') ELSE c_mktsegment END AS permissions, c_nationkey % 5 <> 0 AS guarded FROM customer")
def auth_paths(spark, sf):
    c = read(spark, sf, "customer").withColumn("view", F.concat(F.lit("django.view:"), "c_custkey"))
    allowed = F.when(F.col("c_nationkey") % 2 == 0, F.array("c_mktsegment", F.lit("Any"))).otherwise(F.array("c_mktsegment"))
    edges = c.where("c_nationkey % 5 <> 0").select(F.col("view").alias("src"), F.explode(allowed).alias("p")).select("src", F.concat(F.lit("django.permission:"), "p").alias("dst"), F.lit("has_permission").alias("type"))
    found = score.auth_path(_graph(spark, c.select(F.col("view").alias("id"), F.lit("django.view").alias("type"), F.col("c_name").alias("name")), edges))
    return found.select("id", F.array_join("permissions", ",").alias("permissions"), "guarded")


@query(on_lens(f"SELECT id, type, name, file_path, context FROM nodes WHERE type IN {_in(*SINK_TYPES)}"))
def sink_summaries(spark, sf):
    return score.sink_summaries(lens(spark, sf)).drop("broker")


@query(on_lens("SELECT direction, type, count(*) AS n FROM (SELECT 'out' AS direction, type FROM edges WHERE src = 'django.app:NATION_3' UNION ALL SELECT 'in', type FROM edges WHERE dst = 'django.app:NATION_3' AND src <> dst) GROUP BY 1, 2"))
def degree_histogram(spark, sf):
    return graph.degree_histogram(lens(spark, sf), "django.app:NATION_3")


@query(on_lens("SELECT 'o' || n_nationkey % 7 AS owner, min(r_name) AS context FROM nr WHERE r_name IN (SELECT context FROM nodes) GROUP BY 1"))
def suggested_reviewers(spark, sf):
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = n.select(F.col("r_name").alias("context"), F.concat(F.lit("o"), F.col("n_nationkey") % 7).alias("owner"), F.col("n_nationkey").alias("pos"))
    return score.suggested_reviewers(lens(spark, sf), owners)


@query("SELECT DISTINCT 'django.field' AS type, 'f' || p_size AS name FROM part WHERE p_size % 2 = 0 AND p_size >= 10")
def untested_fields(spark, sf):
    """Fields of even size changed, and those below ten are mentioned by tests."""
    p = read(spark, sf, "part").withColumn("field", F.concat(F.lit("f"), "p_size"))
    fields = p.select(F.concat(F.lit("django.field:"), "p_partkey").alias("id"), F.lit("django.field").alias("type"), F.col("field").alias("name"))
    tests = p.where("p_size < 10").select(F.concat(F.lit("django.test:"), "p_partkey").alias("id"), F.lit("django.test").alias("type"), F.to_json(F.struct(F.array("field").alias("mentions"))).alias("extra"))
    return score.untested_fields(_graph(spark, fields.unionByName(tests, True)), p.where("p_size % 2 = 0").select(F.col("field").alias("name")))


@query("SELECT 'breaking' AS kind, string_agg(field, ',' ORDER BY field) AS fields FROM (SELECT DISTINCT 'f' || p_size AS field FROM part WHERE p_size % 2 = 0 ORDER BY field LIMIT 12)")
def contract_break(spark, sf):
    """A serializer's file loses the fields of even size and gains the others; twelve are named."""
    sizes = read(spark, sf, "part").select("p_size").distinct()
    line = F.concat(F.when(F.col("p_size") % 2 == 0, "-").otherwise("+"), F.lit("    'f"), "p_size", F.lit("',"))
    diff = sizes.select(F.lit("api/serializers.py").alias("path"), line.alias("patch"))
    nodes = read(spark, sf, "supplier").select(F.concat(F.lit("django.serializer:"), "s_suppkey").alias("id"), F.lit("django.serializer").alias("type"), F.lit("api/serializers.py").alias("file_path"))
    return score.contract_break(_graph(spark, nodes), diff).select("kind", F.array_join("fields", ",").alias("fields"))


# --- reviews and changes ------------------------------------------------------------------------------

_REVIEWS = "r AS (SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'click' THEN md5(CAST(user_id AS VARCHAR))[:12] WHEN 'view' THEN 'origin/feature/u' || user_id ELSE 'main' END AS head_ref FROM events)"


@query(f"""WITH {_REVIEWS}, p AS (SELECT DISTINCT user_id AS number, md5(CAST(user_id AS VARCHAR)) AS head_sha, 'feature/u' || user_id AS branch FROM events),
m AS (SELECT number, id, created_at FROM p JOIN r ON r.head_ref[:7] = p.head_sha[:7] UNION ALL SELECT number, id, created_at FROM p JOIN r ON r.head_ref = 'origin/' || p.branch)
SELECT number, id AS review FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY created_at, id) AS nth FROM m) WHERE nth = 1""")
def reviews_of_requests(spark, sf):
    e, user = read(spark, sf, "events"), F.col("user_id").cast("string")
    head = F.when(F.col("event_type") == "click", F.substring(F.md5(user), 1, 12)).when(F.col("event_type") == "view", F.concat(F.lit("origin/feature/u"), user)).otherwise("main")
    reviews = e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), head.alias("head_ref"))
    prs = e.select(F.col("user_id").alias("number"), F.md5(user).alias("head_sha"), F.concat(F.lit("feature/u"), user).alias("branch")).distinct()
    return history.match_reviews_to_prs(reviews, prs)


@query("SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'high' ELSE 'low' END AS level, CAST(user_id % 9 AS INTEGER) AS sinks, CASE WHEN event_type = 'click' THEN 'breaking' ELSE 'none' END AS contract_break, CAST(1 + user_id % 2 AS INTEGER) AS findings, event_type = 'view' AS what_if FROM events")
def stored_reviews(spark, sf):
    """Reviews with two findings, of which one is waived for every other user."""
    u = F.col("user_id")
    payload = F.to_json(F.struct(
        F.struct(F.when(u % 2 == 0, "high").otherwise("low").alias("level"), (u % 9).alias("sinks"), F.lit(0).alias("covered_sinks")).alias("confidence"),
        F.struct(F.when(F.col("event_type") == "click", "breaking").otherwise("none").alias("kind")).alias("contract_break"),
        F.array(F.struct(F.lit(False).alias("waived")), F.struct((u % 2 == 0).alias("waived"))).alias("findings"), (F.col("event_type") == "view").alias("what_if"),
    ))
    rows = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.lit("main").alias("base_ref"), F.lit("x").alias("head_ref"), payload.alias("payload"))
    return history.summarize_reviews(rows).select("id", "level", "sinks", "contract_break", "findings", "what_if")


@query("SELECT event_id AS id, ts AS created_at FROM events ORDER BY ts DESC, event_id LIMIT 200")
def newest_reviews(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("props").alias("payload"))
    return history.list_reviews(rows, 500)


_PAIRS = f"""{_COMMITS}, n AS (SELECT file, count(*) AS n FROM c GROUP BY file), pairs AS (SELECT a, b, together, na.n AS of_a, nb.n AS of_b FROM (SELECT x.file AS a, y.file AS b, count(*) AS together FROM c x JOIN c y ON x.sha = y.sha AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 3) p JOIN n na ON na.file = a JOIN n nb ON nb.file = b),
cpl AS (SELECT a, b, together, round(together / greatest(of_a, of_b), 3) AS degree, right(a, 4) <> right(b, 4) AS cross_context FROM (SELECT * FROM pairs ORDER BY together DESC, a, b LIMIT 40) WHERE (right(a, 4) < '5') <> (right(b, 4) < '5') ORDER BY together DESC, a, b LIMIT 12)"""


def _couplings(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Hotspots, and couplings: files whose number ends below five are on the path; a context for each last digit."""
    c = commits(spark, sf)
    files = c.select("file").distinct()
    return evolution.hotspots(c), evolution.couplings(evolution.co_change(c), files.where("right(file, 4) < '5'"), files.select("file", F.right("file", F.lit(4)).alias("context")))


@query(f"WITH {_PAIRS} SELECT * FROM cpl")
def couplings(spark, sf):
    return _couplings(spark, sf)[1]


@query(f"""WITH {_PAIRS}, h AS (SELECT file, count(DISTINCT sha) AS commits, count(DISTINCT author) AS authors FROM c GROUP BY file)
SELECT * FROM (SELECT CASE WHEN commits >= 5 AND authors = 1 THEN 'silo' WHEN commits >= 8 THEN 'hotspot' END AS kind, file AS subject, commits AS n FROM h
UNION ALL SELECT CASE WHEN cross_context AND degree >= 0.4 THEN 'hidden_coupling' WHEN degree >= 0.6 THEN 'coupling' END, a || ' ' || b, together FROM cpl) WHERE kind IS NOT NULL""")
def evolution_notes(spark, sf):
    return evolution.notes(*_couplings(spark, sf))


_FUNCTIONS = "fn AS (SELECT DISTINCT p_brand AS path, p_size AS name, p_size * 10 AS start, p_size * 10 + 4 AS \"end\", p_size % 7 AS complexity FROM part), ln AS (SELECT p_brand AS path, p_partkey % 500 AS line FROM part)"


@query(f'WITH {_FUNCTIONS} SELECT path, sum(complexity) AS complexity FROM fn WHERE EXISTS (SELECT 1 FROM ln WHERE ln.path = fn.path AND line BETWEEN start AND "end") GROUP BY 1')
def changed_complexity(spark, sf):
    """Functions of ten lines each, of which half may hold a changed line."""
    p, n = read(spark, sf, "part"), F.col("p_size")
    functions = p.select(F.col("p_brand").alias("path"), n.alias("name"), (n * 10).alias("start"), (n * 10 + 4).alias("end"), (n % 7).alias("complexity")).distinct()
    return evolution.file_complexity(functions, p.select(F.col("p_brand").alias("path"), (F.col("p_partkey") % 500).alias("line")))


@query("SELECT unnest(['a/c' || conv_id || '.py', 't' || turn || '.html']) AS path, unnest([md5('diff --git a/a/c' || conv_id || '.py b/a/c' || conv_id || '.py' || chr(10) || '+' || text || chr(10)), md5('diff --git a/t' || turn || '.html b/t' || turn || '.html' || chr(10) || '-' || text)]) AS hash FROM conversations WHERE text IS NOT NULL")
def patches_by_file(spark, sf):
    """Every message as a change of two files."""
    a, b = F.concat(F.lit("a/c"), "conv_id", F.lit(".py")), F.concat(F.lit("t"), "turn", F.lit(".html"))
    head = lambda x: F.concat(F.lit("diff --git a/"), x, F.lit(" b/"), x, F.lit("\n"))
    patch = F.concat(head(a), F.lit("+"), "text", F.lit("\n"), head(b), F.lit("-"), "text")
    return evolution.split_patches(read(spark, sf, "conversations").where("text is not null").select(patch.alias("patch"))).select("path", F.md5("patch").alias("hash"))
