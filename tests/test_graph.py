"""Small graphs by hand: walks, folds, rules, scores."""

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import paths, urls
from sparkweave.operators import evolution, graph, history, rules, score, stitch, traverse
from sparkweave.operators.components import connected_components
from sparkweave.operators.scratch import Scratch
from sparkweave.schema import EDGE_TYPES, NODE_TYPES, NODES


def make(spark, nodes, edges):
    """nodes: id, type, context (, extra, file, name); edges: src, type, dst (, confidence, extra)."""
    rows = [(n[0], n[1], n[5] if len(n) > 5 else n[0], n[0], n[4] if len(n) > 4 else None, None, None, n[2], n[3] if len(n) > 3 else None) for n in nodes]
    e = [(s, d, t, r[0] if r else 1.0, r[1] if len(r) > 1 else None) for s, t, d, *r in edges]
    return graph.Graph(spark.createDataFrame(rows, NODES), graph.make_edges(spark.createDataFrame(e, "src string, dst string, type string, confidence double, extra string")))


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_vocabulary():
    assert len(NODE_TYPES) == 46 and len(set(EDGE_TYPES)) == 28


BARRIER = [("S", "django.view", "A"), ("Z", "django.serializer", "A"), ("M", "django.model", "B"), ("F", "django.field", "B")]


@pytest.mark.parametrize(("hops", "want"), [(1, "SMZ"), (2, "SMZ"), (3, "SMZF")])
def test_kept_is_not_expanded(spark, hops, want):
    g = make(spark, BARRIER, [("S", "queries_model", "M"), ("S", "uses_serializer", "Z"), ("Z", "serializes", "M"), ("M", "has_field", "F")])
    assert ids(traverse.impact_walk(g, seeds(spark, "S"), hops).nodes) == set(want)


def test_barrier_holds_without_another_way(spark):
    g = make(spark, BARRIER, [("S", "queries_model", "M"), ("S", "uses_serializer", "Z"), ("M", "has_field", "F")])
    assert ids(traverse.impact_walk(g, seeds(spark, "S")).nodes) == set("SMZ")


def test_hubs_features_and_relations(spark):
    g = make(spark, [("V1", "django.view", "A"), ("V2", "django.view", "A"), ("P", "django.permission", None)], [("V1", "has_permission", "P"), ("V2", "has_permission", "P")])
    assert ids(traverse.impact_walk(g, seeds(spark, "V1")).nodes) == {"V1", "P"}
    g = make(spark, [("page", "react.page", None), ("feature", "react.feature", None), ("model", "django.model", None), ("app", "django.app", None)], [("page", "belongs_to", "feature"), ("model", "belongs_to", "app")])
    assert ids(traverse.impact_walk(g, seeds(spark, "feature")).nodes) == {"page", "feature"}
    assert ids(traverse.impact_walk(g, seeds(spark, "app")).nodes) == {"app"}
    for context, want in (("B", {"f"}), (None, {"f", "m"})):
        g = make(spark, [("f", "django.field", "A"), ("m", "django.model", context)], [("f", "relates_to", "m")])
        assert ids(traverse.impact_walk(g, seeds(spark, "f")).nodes) == want


def test_cycles_end_and_paths_are_isolated(spark):
    g = make(spark, [(x, "django.view", None) for x in "1234"], [("1", "calls", "2"), ("2", "calls", "3"), ("3", "calls", "1"), ("3", "calls", "4")])
    assert ids(traverse.reach(g.edges, seeds(spark, "1"), 50)) == set("1234")
    assert {(r["id"], r["hop"]) for r in traverse.k_hop(g, seeds(spark, "4"), 2).collect()} == {("4", 0), ("3", 1), ("1", 2), ("2", 2)}
    g = make(spark, [(x, "django.view", None) for x in ("a", "b", "c", "noise")], [("a", "calls", "b"), ("b", "calls", "c"), ("b", "calls", "noise")])
    found = traverse.isolate_paths(g, seeds(spark, "a"), seeds(spark, "c"))
    assert ids(found.nodes) == {"a", "b", "c"} and found.edges.count() == 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3)]
    got = {(r["node"], r["component"]) for r in connected_components(spark.createDataFrame(edges, "a int, b int"), Scratch(spark)).collect()}
    assert got == {(i, 0) for i in range(61)} | {(1000 + i, 1000) for i in range(200)}


def test_clusters_share_neighbours(spark):
    e = make(spark, [], [("a", "calls", "x"), ("b", "calls", "x"), ("y", "calls", "z")]).edges
    assert {tuple(r) for r in traverse.change_clusters(e, seeds(spark, "a", "b", "c")).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


@pytest.mark.parametrize("order", [(1, 2), (2, 1)])
def test_definition_outlives_reference(spark, order):
    rows = [("t", "django.task", "t", "t", "tasks.py", 3, None, None, False, "[pk]", "celery", None, order[0]), ("t", "django.task", "t", "t", "views.py", 9, None, None, True, None, "dramatiq", "billing", order[1])]
    df = spark.createDataFrame(rows, "id string, type string, name string, qualified_name string, file_path string, start_line int, end_line int, context string, referenced boolean, args string, broker string, app string, seq int")
    r = graph.merge_nodes(df, ["args", "broker", "app"]).first()
    assert (r["file_path"], r["args"], r["app"], r["referenced"]) == ("tasks.py", "[pk]", "billing", False)
    assert r["broker"] == ("dramatiq" if order == (1, 2) else "celery")


def test_edges_last_wins_and_dangling(spark):
    rows = spark.createDataFrame([("a", "b", 0.4, 1), ("a", "b", 0.9, 2)], "src string, dst string, confidence double, seq int")
    assert [tuple(r) for r in graph.last_wins(rows, ["src", "dst"], "seq").collect()] == [("a", "b", 0.9)]
    g = make(spark, [("a", "django.view", None)], [("a", "calls", "b"), ("c", "calls", "a"), ("a", "calls", "a")])
    assert ids(g.pruned().edges) == {"a|calls|a"} and graph.dangling(g.edges, g.nodes).count() == 2


def finding_ids(df):
    return {(r["node_id"], r["subject"]) for r in df.collect()}


def test_rules_find_and_spare(spark):
    apps = spark.createDataFrame([("shop", "B")], "app string, context string")
    g = make(spark, [("v", "django.view", "A"), ("w", "django.view", "B"), ("shop.m", "django.model", None)], [("v", "queries_model", "shop.m"), ("w", "queries_model", "shop.m")])
    assert finding_ids(rules.foreign_models(g, apps)) == {("v", "shop.m")}
    g = make(spark, [("t1", "django.task", None, '{"args":["email"],"looks_idempotent_on_pk":false}'), ("t2", "django.task", None, '{"args":["user_id"],"looks_idempotent_on_pk":true}'), ("t3", "django.task", None, '{"referenced":true,"args":["x"]}')], [])
    assert finding_ids(rules.task_idempotency(g)) == {("t1", "t1")}
    g = make(spark, [("s", "django.serializer", None, '{"queryset_in_serializer":true}'), ("r", "django.serializer", None)], [])
    assert finding_ids(rules.queryset_in_serializer(g)) == {("s", "s")}
    fields = [("a.M.owner", "django.field", "A", '{"app":"a","field_type":"ForeignKey","on_delete":"CASCADE"}', None, "owner"), ("a.M.total", "django.field", "A", '{"app":"a","field_type":"IntegerField"}', None, "total"), ("b.N.total", "django.field", "B", '{"app":"b","field_type":"IntegerField","db_index":true}', None, "total")]
    hook = '{"app":"%s","nplusone":[{"line":1,"loop_var":"x","accessed":["owner","total","mystery"]}],"lookups":[{"kind":"filter","fields":["total","owner","unknown"],"line":2}]}'
    g = make(spark, fields + [("h", "django.view", "A", hook % "a"), ("k", "django.view", "B", hook % "b")], [])
    assert finding_ids(rules.nplusone(g)) == {("h", "mystery,owner"), ("k", "mystery,owner")}
    assert finding_ids(rules.missing_index(g)) == {("h", "total a.M.total")}
    g = make(spark, fields + [("b.N", "django.model", "B")], [("a.M.owner", "relates_to", "b.N", 1.0, '{"on_delete":"CASCADE"}'), ("a.M.total", "relates_to", "b.N", 1.0, '{"on_delete":"SET_NULL"}')])
    assert finding_ids(rules.cascades(g, apps)) == {("a.M.owner", "b.N")}


def test_drift_seams_and_interfaces(spark):
    g = make(
        spark,
        [("s", "django.serializer", None), ("s.a", "django.serializer_field", None, None, None, "a"), ("f", "react.form_schema", None, '{"fields":["a","gone"]}'), ("f2", "react.form_schema", None, '{"fields":["a"]}')],
        [("s", "matches_schema", "f"), ("s", "matches_schema", "f2")],
    )
    assert finding_ids(rules.contract_drift(g)) == {("f", "gone")}
    nodes = [("v", "django.view", "A", None, "views.py"), ("m", "django.model", "A"), ("q", "django.service", "A", None, "z_queries.py"), ("p", "django.service", "A", None, "a_other.py"), ("own", "django.service", "A", None, "views.py")]
    assert finding_ids(rules.leaked_seams(make(spark, nodes, [("v", "queries_model", "m")]))) == {("v", "m a_other")}
    assert finding_ids(rules.leaked_seams(make(spark, nodes, [("v", "queries_model", "m"), ("v", "calls", "p")]))) == {("v", "m z_queries")}
    assert finding_ids(rules.leaked_seams(make(spark, nodes, [("v", "queries_model", "m"), ("q", "queries_model", "m")]))) == {("v", "m q")}
    assert not finding_ids(rules.leaked_seams(make(spark, nodes, [("v", "queries_model", "m", 0.8, '{"imported":true}')])))
    nodes = [("r", "django.route", None), ("r2", "django.route", None), ("v", "django.view", None), ("s", "django.serializer", None), ("t", "django.test", None)]
    edges = [("r", "publishes_route", "v"), ("r2", "publishes_route", "v"), ("v", "uses_serializer", "s"), ("s", "tested_by", "t"), ("r2", "tested_by", "t")]
    assert finding_ids(rules.bypassed_interfaces(make(spark, nodes, edges))) == {("r", "s")}


def test_blast_radius_and_public_apis(spark):
    op = '{"op":"RemoveField","app":"a","model_name":"Invoice","field_name":"Total"}'
    nodes = [("op", "django.migration_op", None, op), ("op2", "django.migration_op", None, '{"op":"DeleteModel","app":"a","args":["gone"]}'), ("django.field:a.invoice.total", "django.field", None), ("s", "django.serializer", None), ("c", "django.serializer_field", None, None, None, "Total")]
    g = make(spark, nodes, [("s", "serializes", "django.model:a.Invoice"), ("s", "has_field", "c")])
    g = graph.Graph(g.nodes.withColumn("qualified_name", F.regexp_replace("id", "^django.field:", "")), g.edges)
    assert finding_ids(rules.blast_radius(g)) == {("op", "c,django.field:a.invoice.total")}
    apis = spark.createDataFrame([("A", "/api/a", 0), ("B", "/api/b/{id}", 1)], "context string, path string, pos int")
    g = make(spark, [("p", "react.page", "A"), ("/api/b/7", "react.api_client", None), ("/api/a/x", "react.api_client", None)], [("p", "calls", "/api/b/7"), ("p", "calls", "/api/a/x")])
    assert {(r["node_id"], r["subject"], r["other_context"]) for r in rules.foreign_apis(g, apis).collect()} == {("p", "/api/b/7", "B")}


def test_waivers(spark):
    found = spark.createDataFrame([("leaked_seam", "warning", x, None, "", None) for x in "xy"] + [("celery_tasks_must_be_idempotent_on_model_pk", "warning", "x", None, "", None)], "rule string, severity string, node_id string, file_path string, subject string, other_context string")
    for waivers, want in (([("leaked_seam", "x")], {("leaked_seam", "x")}), ([("leaked_seam", None)], {("leaked_seam", "x"), ("leaked_seam", "y")}), ([("async_tasks_must_be_idempotent_on_model_pk", None)], {("celery_tasks_must_be_idempotent_on_model_pk", "x")})):
        got = rules.waive(found, spark.createDataFrame(waivers, "rule string, node string")).where("waived")
        assert {(r["rule"], r["node_id"]) for r in got.collect()} == want


@pytest.mark.parametrize(
    ("sinks", "covered", "blockers", "warnings", "residuals", "want"),
    [(10, 9, 1, 0, 0, "low"), (10, 1, 0, 0, 0, "low"), (10, 2, 0, 0, 0, "medium"), (10, 9, 0, 1, 0, "medium"), (10, 9, 0, 0, 0, "high"), (10, 9, 0, 0, 1, "medium"), (0, 0, 0, 0, 0, "high")],
)
def test_ladder(spark, sinks, covered, blockers, warnings, residuals, want):
    args = [F.lit(x) for x in (sinks, covered, blockers, warnings, 0, 10, residuals)]
    assert spark.range(1).select(score.confidence_level(*args).alias("x")).first()["x"] == want


def test_coverage_roles_and_marks(spark):
    g = make(spark, [("page", "react.page", None, None, "p.tsx"), ("hook", "react.hook", None, None, "h.ts"), ("test", "react.test", None), ("route", "django.route", None)], [("page", "calls", "hook"), ("hook", "tested_by", "test"), ("route", "calls", "page", 0.5)])
    assert {(r["id"], r["covered"]) for r in score.sink_coverage(g).collect()} == {("page", True), ("route", True)}
    assert {(r["id"], r["covered"]) for r in score.sink_coverage(graph.Graph(g.nodes, g.edges.where("type = 'calls'"))).collect()} == {("page", False), ("route", False)}
    roles = score.node_roles(g, seeds(spark, "hook"))
    assert {r["id"]: r["roles"] for r in roles.collect()} == {"page": ["downstream", "sink", "untested", "inferred"], "hook": ["seed", "tested"], "test": ["downstream", "test"], "route": ["downstream", "sink", "contract", "untested", "inferred"]}
    assert {r["path"]: r["lead"] for r in score.file_marks(g, roles).collect()} == {"p.tsx": "untested", "h.ts": "seed"}
    fields = spark.createDataFrame([("server", "total"), ("server", "status"), ("client", "status"), ("server", "id")], "side string, field string")
    assert {r["field"]: r["status"] for r in score.contract_sides(fields).collect()} == {"total": "missing_client", "status": "aligned"}


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("/api/invoices/{id}", "/invoices/{id}", True), ("/api/invoices/{id}", "/api/invoices/{pk}", True), ("/api/invoices/{id}", "/internal/invoices/{id}", False), ("/api/invoices/{id}", "/api/invoices", False), ("/api/invoices/{id}", "/api/invoices/{id}/ledger", False)],
)
def test_url_match(spark, a, b, want):
    assert spark.range(1).select(urls.paths_match(F.lit(a), F.lit(b)).alias("x")).first()["x"] is want
    c, r = spark.createDataFrame([(1, a)], "client int, url string"), spark.createDataFrame([(2, b)], "route int, path string")
    assert (stitch.match_routes(c, r).count() == 1) is want


def test_url_templates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(urls.normalize_url(F.lit("/api/invoices/${id}"))) == "/api/invoices/{id}"
    assert one(urls.normalize_url(F.lit("https://h.io/a//:b/"))) == "/a/{id}"
    assert one(urls.route_template(F.lit(r"^(?P<slug>(?:[\w-]+))/$"))) == "/{id}" and one(urls.route_template(F.lit("^$"))) == "/" and one(urls.strip_anchors(F.lit("^"))) == ""
    assert one(urls.join_route(F.lit("api/"), F.lit("x/<int:pk>/"))) == "/api/x/{id}" and one(urls.join_base(F.lit("/v1/"), F.lit("/a"))) == "/v1/a"
    assert one(paths.mask(F.lit("abcdefghijkl"))) == "****ijkl" and one(paths.slug(F.lit("A b-C!"))) == "a_b_c"
    assert "hunter2" not in one(paths.redact(F.lit("https://me:hunter2@host/x")))


def test_owners_similarity_and_suffixes(spark):
    listed = [("*", ["everyone"]), ("/backend/", ["backend"]), ("/backend/billing/", ["billing", "alice"]), ("*.md", ["docs"])]
    files = spark.createDataFrame([("frontend/src/App.tsx",), ("backend/accounts/models.py",), ("backend/billing/serializers.py",), ("README.md",)], "path string")
    assert {r["path"]: r["owners"] for r in stitch.owners_of(files, listed).collect()} == {"frontend/src/App.tsx": ["everyone"], "backend/accounts/models.py": ["backend"], "backend/billing/serializers.py": ["billing", "alice"], "README.md": ["docs"]}
    server = spark.createDataFrame([("s1", f) for f in "abcd"] + [("s2", f) for f in "axy"], "key string, field string")
    form = spark.createDataFrame([("f", f) for f in "abc"], "key string, field string")
    assert [tuple(r) for r in stitch.schema_similarity(server, form).collect()] == [("s1", "f", 3, 4)]
    calls = spark.createDataFrame([("c", "/x"), ("d", "/nope")], "call string, url string")
    routes = spark.createDataFrame([("r2", "/b/x"), ("r1", "/a/b/x"), ("r3", "/bx")], "route string, path string")
    assert [tuple(r) for r in stitch.match_suffix(calls, routes).collect()] == [("c", "r1")]
    clients = spark.createDataFrame([("a", "GetX", ["other"]), ("b", "Mine", ["no", "getx", "gety"]), ("c", "None", [])], "client string, name string, selections array<string>")
    servers = spark.createDataFrame([("sx", "getX"), ("sy", "getY")], "server string, name string")
    assert {tuple(r) for r in stitch.match_graphql(clients, servers).collect()} == {("a", "sx"), ("b", "sx")}


def test_history(spark):
    days = spark.createDataFrame([("c", f"2024-01-{d:02}") for d in range(1, 31)], "context string, created_at string")
    assert sorted(r["created_at"] for r in history.architecture_health(days).collect()) == [f"2024-01-{d:02}" for d in range(7, 31)]
    level = spark.createDataFrame([("r", 1, "medium"), ("r", 2, "low"), ("r", 3, "high")], "range string, created_at int, level string")
    assert [r["direction"] for r in history.confidence_trend(level, ["range"]).orderBy("created_at").collect()] == ["new", "dropped", "improved"]
    prs = spark.createDataFrame([(1, "abcdef1234", "x/feature"), (2, "zzz", "fix")], "number int, head_sha string, branch string")
    reviews = spark.createDataFrame([("r2", "2", "abcdef1"), ("r1", "1", "feature"), ("r3", "3", "origin/fix")], "id string, created_at string, head_ref string")
    assert {tuple(r) for r in history.match_reviews_to_prs(reviews, prs).collect()} == {(1, "r1"), (2, "r3")}


def test_evolution(spark):
    rows = [(f"s{i}", "ann", f) for i in range(5) for f in ("a.py", "b.py")] + [("s9", "bob", "b.py")]
    commits = spark.createDataFrame(rows, "sha string, author string, file string")
    pairs = evolution.co_change(commits)
    assert [tuple(r) for r in pairs.collect()] == [("a.py", "b.py", 5, 5, 6)]
    on = spark.createDataFrame([("a.py",)], "file string")
    contexts = spark.createDataFrame([("a.py", "A"), ("b.py", "B")], "file string, context string")
    top = evolution.couplings(pairs, on, contexts)
    assert {r["kind"] for r in evolution.notes(evolution.hotspots(commits), top).collect()} == {"silo", "hidden_coupling"}
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n a\n+b\n-c\n d\n@@ -9 +10,2 @@\n+e\n f\ndiff --git a/y b/y\n@@ -0,0 +1 @@\n+z"
    parts = evolution.split_patches(spark.createDataFrame([(patch,)], "patch string"))
    assert {tuple(r) for r in evolution.changed_lines(parts).collect()} == {("x.py", 2), ("x.py", 10), ("y", 1)}
    functions = spark.createDataFrame([("x.py", "f", 1, 3, 2), ("x.py", "g", 4, 9, 1)], "path string, name string, start int, end int, complexity int")
    assert [r["name"] for r in evolution.touched_functions(functions, evolution.changed_lines(parts)).collect()] == ["f"]


def test_contract_breaks(spark):
    nodes = [("s", "django.serializer", None, None, "s.py"), ("f", "react.form_schema", None, '{"fields":["a"]}', "f.ts"), ("x", "django.serializer_field", None, None, "s.py", "a"), ("y", "django.serializer_field", None, None, "s.py", "b")]
    g = make(spark, nodes, [])

    def kind(graph_, *files):
        r = score.contract_break(graph_, spark.createDataFrame(files, "path string, patch string")).first()
        return r["kind"], r["fields"]

    assert kind(g, ("s.py", '@@\n-    "gone",\n+    "new",')) == ("breaking", ["gone"])
    assert kind(g, ("s.py", '+    "new",')) == ("additive", ["new"])
    assert kind(g, ("s.py", "+x"), ("f.ts", "+y")) == ("drift", ["b"])
    assert kind(g, ("z.py", '+    extra_kwargs = {"total": {"required": True}}')) == ("breaking", ["total"])
    assert kind(graph.Graph(g.nodes.where("false"), g.edges), ("s.py", '-    "gone",')) == ("none", [])


def test_residuals_of_fields_and_ui(spark):
    nodes = [("k", "react.query_key", None), ("h", "react.hook", None, '{"mutation":true}'), ("p", "react.page", None, '{"has_error_boundary":false}', "p.tsx"), ("f", "react.form_schema", None, '{"fields":["a"]}'), ("x", "django.field", None, None, None, "a"), ("y", "django.field", None, None, None, "b"), ("t", "django.test", None, '{"mentions":["a"]}')]
    g = make(spark, nodes, [])
    names, changed = spark.createDataFrame([("a",), ("b",), ("id",)], "name string"), spark.createDataFrame([("p.tsx",)], "path string")
    assert {tuple(r) for r in score.untested_fields(g, names).collect()} == {("django.field", "b")}
    assert {r["what"] for r in score.ui_residuals(g, changed, names).collect()} == {"a mutation leaves the page's queries stale", "no error boundary: p", "not in a form: b"}


def test_kinds_gate_and_risk(spark):
    found = spark.createDataFrame([(rules.RULES[0], False)], "rule string, waived boolean")
    g = make(spark, [("s", "django.serializer", None), ("q", "django.service", None), ("m", "django.model", None)], [])
    kinds = lambda graph_, f, s=None: {r["kind"] for r in score.classify_change(graph_, f, s).collect()}
    assert kinds(g, found, g.of_types("django.serializer")) == {"public_contract", "cross_context"}
    assert kinds(g, found.where("waived"), g.of_types("django.service")) == {"internal_service"}
    ui = make(spark, [("c", "react.component", None), ("p", "react.page", None)], [])
    assert kinds(ui, found.where("waived")) == {"leaf_ui"}
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    low, breaking = F.lit("low"), F.lit("breaking")
    assert [one(score.gate(low, F.lit(n), breaking, mode)) for n, mode in ((1, "never"), (1, "blocker"), (0, "blocker"), (0, "low"))] == [0, 2, 0, 4]
    assert one(score.gate(F.lit("medium"), F.lit(0), F.lit("none"), "medium")) == 3 and one(score.gate(F.lit("medium"), F.lit(0), F.lit("none"), "low")) == 0
    assert one(score.is_low_risk(F.array(F.lit("leaf_ui")), F.lit("medium"), F.lit(0))) and not one(score.is_low_risk(F.array(F.lit("auth")), F.lit("high"), F.lit(0)))


def test_visible_graph_and_progress(spark):
    g = make(spark, [("v", "django.view", None), ("f", "django.field", None), ("p", "react.page", None), ("m", "django.model", None)], [("v", "calls", "m"), ("m", "has_field", "f"), ("p", "calls", "v")])
    assert ids(score.visible_graph(g, ["django"]).nodes) == {"v", "f", "m"} and ids(score.visible_graph(g, ["django"], True).nodes) == {"v", "m"}
    assert ids(score.visible_graph(g, ["django", "react"], focus="v").nodes) == {"v", "m", "p"}
    rows = spark.createDataFrame([("scan", 5, 10, 0), ("extract", 1, 0, 0), ("stitch", 1, 1, 0), ("what", 1, 1, 33), ("scan", 0, 10, 50)], "phase string, done int, total int, floor int")
    assert [r["x"] for r in rows.select(history.overall_percent(*(F.col(c) for c in rows.columns)).alias("x")).collect()] == [10, 20, 99, 33, 50]


def test_merged_versions_equal_an_ordered_fold(spark):
    import random

    rng = random.Random(4)
    plain, kept, keys = ("type", "name", "qualified_name", "end_line"), ("file_path", "start_line", "context"), ("a", "b")
    rows = []
    for i in range(300):
        for seq in range(rng.randrange(1, 7)):
            some = lambda x: x if rng.random() < 0.5 else None
            rows.append((f"n{i}", "t", f"v{seq}", None, some(seq), some(f"f{seq}"), some(10 + seq), some(f"c{seq}"), rng.choice([True, True, False, None]), seq, some(f"a{seq}"), some(f"b{seq}")))
    names = ["id", *plain, *kept, "referenced", "seq", *keys]

    def fold(old, new):
        ref, was = bool(new["referenced"]), bool(old["referenced"])
        out = dict(new) | {k: new[k] if new[k] is not None else old[k] for k in keys}
        if ref and not was:
            out |= {c: old[c] if old[c] is not None else new[c] for c in kept}
        return out | {"referenced": new["referenced"] if ref == was else False}

    want = {}
    for r in (dict(zip(names, r, strict=True)) for r in rows):
        want[r["id"]] = fold(want[r["id"]], r) if r["id"] in want else r
    table = spark.createDataFrame(rows, "id string, type string, name string, qualified_name string, end_line int, file_path string, start_line int, context string, referenced boolean, seq int, a string, b string")
    merged = graph.merge_nodes(table.repartition(7), list(keys))
    got = {r["id"]: r.asDict() for r in merged.collect()}
    assert got == {i: {k: v for k, v in r.items() if k != "seq"} for i, r in want.items()}
    assert "collect_list" not in merged._jdf.queryExecution().toString()


def test_a_hop_moves_the_frontier_alone(spark):
    scratch = Scratch(spark)
    rows = [(f"n{i}", f"n{i + 1}", True) for i in range(50)]
    steps = scratch.bucketed(spark.createDataFrame(rows, "n string, other string, expand boolean"), "n", 4)
    assert sorted(map(tuple, steps.collect())) == sorted(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = scratch.cut(spark.createDataFrame([("n3",)], "n string"))
        hop = steps.join(frontier.hint("shuffle_hash"), "n", "left_semi")
        plan = hop._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "SelectedBucketsCount" in plan
        assert [r["other"] for r in hop.collect()] == ["n4"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scratch.drop(steps)
    far, _ = traverse.walk(spark.createDataFrame(rows, "n string, other string, expand boolean"), seeds(spark, "n10"), 5, edges=False)
    assert {r["id"]: r["hop"] for r in far.collect()} == {f"n{10 + i}": i for i in range(6)}


def test_named_groups_nest(spark):
    cases = {
        r"^a/(?P<x>[^/]+)/$": "/a/{id}", r"(?P<x>(?:(?:a|b(c(d))))+)/z": "/{id}/z", r"(?P<x>[)(]+)/(?P<y>\)\()/w": "/{id}/{id}/w", "plain/<int:pk>/": "/plain/{id}",
        r"a(b|c)/(?P<y>\d{4})": "/a(b|c)/{id}", r"(?P<x>[^/.]+(\.(?P<fmt>json|(x(m)l)))?)/q": "/{id}/q",
    }
    got = spark.createDataFrame([(k,) for k in cases], "r string").select("r", urls.route_template(F.col("r")).alias("t"), urls.named_groups(F.col("r")).alias("n")).collect()
    assert {r["r"]: r["t"] for r in got} == cases
    assert {r["n"] for r in got} >= {"{x}/z", "{x}/{y}/w", "plain/<int:pk>/", "a(b|c)/{y}"}
    open_ = spark.createDataFrame([("a/(?P<x>[^/]+",), ("(?P<x>",)], "r string").select(urls.named_groups(F.col("r")).alias("n"))
    assert [r["n"] for r in open_.collect()] == ["a/(?P<x>[^/]+", "(?P<x>"]


def test_published_paths_are_found_by_keys(spark):
    paths, found = ["/a/{id}", "/a", "/a/b/", "/{id}", "/", "/a/<int:pk>/c", "/ab"], ["/a", "/a/7", "/a/${x}", "/a/b/c/d", "/ab/c", "/", "/a/:id/c/:n", "/x"]
    rows = spark.createDataFrame([(u, p) for u in found for p in paths], "u string, p string")
    strip = lambda t: t.removesuffix("/{id}")
    shown = rows.select("u", "p", urls.path_belongs(F.col("u"), F.col("p")).alias("b"), urls.normalize_url(F.col("u")).alias("nu"), urls.route_template(F.col("p")).alias("np")).collect()
    for r in shown:
        assert r["b"] == (r["nu"] == r["np"] or strip(r["nu"]) == strip(r["np"]) or r["nu"].startswith(strip(r["np"]) + "/")), r


def test_calls_of_apis_meet_by_hash_joins(spark):
    g = make(spark, [("p", "react.page", "a"), ("c", "react.api_client", None)], [("p", "calls", "c")])
    apis = spark.createDataFrame([("a", "/x", 0), ("b", "/c", 1)], "context string, path string, pos int")
    plan = rules.foreign_apis(g, apis)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_sketches_by_kind_of_sink(spark):
    rows = [(t, f"Name {t}") for t in (*score.SKETCHES, "django.permission")]
    got = {r["type"]: r for r in score.suggested_tests(spark.createDataFrame(rows, "type string, name string"), 50).collect()}
    assert {t: r["kind"] for t, r in got.items()} == {t: k for t, (k, _, _) in score.SKETCHES.items()} | {"django.permission": None}
    flag = got["django.feature_flag"]
    assert flag["title"] == "Both sides of the flag Name django.feature_flag" and "def test_name_django_feature_flag(client" in flag["body"] and "set_flag('Name django.feature_flag', on)" in flag["body"]
    assert all("{ident}" not in (r["body"] or "") and "{name}" not in (r["body"] or "") for r in got.values())
    for r in got.values():
        if r["kind"] in ("pytest", "django", "graphql", "channels"):
            compile(r["body"], "sketch", "exec")


def test_touched_functions_by_stretches_of_lines(spark):
    functions = spark.createDataFrame([("a", "far", 10, 1000, 1), ("a", "far", 10, 1000, 1), ("a", "none", 1001, 1002, 1), ("a", "turned", 9, 3, 1), ("b", "edge", 63, 64, 1), (None, "x", 1, 9, 1)], "path string, name string, start int, end int, complexity int")
    # very many patches that name the same lines: each line meets the functions once, and only those near it
    lines = spark.range(20_000).select(F.expr("if(id % 2 = 0, 'a', 'b')").alias("path"), F.expr("cast(if(id % 2 = 0, 500 + id % 3, 64) as int)").alias("line"))
    got = evolution.touched_functions(functions, lines.unionByName(spark.createDataFrame([("a", None), ("a", 5), (None, 5)], "path string, line int")))
    assert sorted(r["name"] for r in got.collect()) == ["edge", "far", "far"] and got.columns == functions.columns
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bin" in plan and plan.count("Aggregate") >= 2


def test_rules_over_numbers_judge_by_labels(spark):
    # 1: dropped model, 2: its user, 3: route, 4 and 5: views, of which the last by label is tested, 6: the migration
    rows = [(1, "django.model:a.invoice", "django.model", "invoice", "a.invoice", None), (2, "django.view:a.V", "django.view", "V", "a.V", None), (3, "django.route:r", "django.route", "r", "r", None), (4, "django.view:z", "django.view", "z", "z", None), (5, "django.view:b", "django.view", "b", "b", None), (6, "django.migration_op:m", "django.migration_op", "m", "m", '{"op": "DeleteModel", "app": "a", "model_name": "Invoice"}')]
    nodes = spark.createDataFrame(rows, "id long, label string, type string, name string, qualified_name string, extra string").selectExpr("*", "'f' AS file_path", "string(null) AS context")
    edges = spark.createDataFrame([(2, 1, "queries_model"), (3, 4, "publishes_route"), (3, 5, "publishes_route"), (4, 9, "tested_by")], "src long, dst long, type string")
    g = graph.Graph(nodes, edges)
    assert [tuple(r) for r in rules.blast_radius(g).select("node_id", "subject").collect()] == [(6, "django.model:a.invoice,django.view:a.V")]
    assert [tuple(r) for r in rules.bypassed_interfaces(g).select("node_id", "subject").collect()] == [(3, "z")]


def test_whole_sets_are_compared_as_their_fields(spark):
    server = spark.createDataFrame([("s1", f) for f in "abcd"] + [("s2", f) for f in "xy"], "key string, field string")
    held = spark.createDataFrame([("f", ["a", "b", None, "c", "a"]), ("g", ["q"]), ("h", [])], "key string, fields array<string>")
    assert [tuple(r) for r in stitch.schema_similarity(server, held).collect()] == [("s1", "f", 3, 4)]


def test_uses_of_a_name_stay_one_row_each(spark):
    """However many fields of an app have the name that a loop touches, none is met one by one."""
    n = 40
    nodes = [(f"f{i}", "django.field", "base", f"a.M{i}.base", None, '{"app":"a","field_type":"%s"}' % ("ForeignKey" if i == 3 else "CharField")) for i in range(n)]
    nodes += [(f"v{i}", "django.view", f"v{i}", f"a.v{i}", "a.py", '{"app":"a","nplusone":[{"line":1,"loop_var":"x","accessed":["base"]}],"lookups":[{"kind":"filter","fields":["base"],"line":2}]}') for i in range(n)]
    g = graph.Graph(spark.createDataFrame(nodes, "id string, type string, name string, qualified_name string, file_path string, extra string"), None)
    assert finding_ids(rules.nplusone(g)) == {(f"v{i}", "base") for i in range(n)}
    assert finding_ids(rules.missing_index(g)) == {(f"v{i}", "base a.M0.base") for i in range(n)}
    uses = g.of_types("django.view").select(F.col("id").alias("node_id"), F.lit("a").alias("app"), F.lit("base").alias("field"))
    assert rules._scoped(uses, rules._fields(g)).count() == n


def test_serializers_with_equal_fields_give_a_finding_each(spark):
    nodes = [(f"s{i}", "django.serializer", f"S{i}") for i in range(3)] + [("f", "react.form_schema", "f")]
    nodes += [(f"s{i}.{x}", "django.serializer_field", f"S{i}.{x}") for i in range(3) for x in ("a", "b")[: 2 - i // 2]]
    rows = spark.createDataFrame([(i, t, q.rsplit(".", 1)[-1], q, None, None, '{"fields":["a","b","gone"]}' if i == "f" else None) for i, t, q in nodes], "id string, type string, name string, qualified_name string, file_path string, context string, extra string")
    edges = graph.make_edges(spark.createDataFrame([(f"s{i}", "f", "matches_schema") for i in range(3)], "src string, dst string, type string"))
    found = rules.contract_drift(graph.Graph(rows, edges))
    assert sorted(r.subject for r in found.collect()) == ["b,gone", "gone", "gone"]
    # the form meets each set of fields once, not each serializer
    assert "first" in found._jdf.queryExecution().optimizedPlan().toString()


def test_similar_sets_are_compared_without_being_carried_on(spark):
    """Equal sets once; of lefts that are as similar the first."""
    server = spark.createDataFrame([("s2", x) for x in "abcd"] + [("s1", x) for x in "abcd"] + [("s3", x) for x in "abxy"], "key string, field string")
    client = spark.createDataFrame([("g", list("abc")), ("f", list("abc")), ("h", list("xy")), ("i", list("q")), ("j", [None, "a", "b", "x", "y", "y"])], "key string, fields array<string>")
    got = stitch.schema_similarity(server, client, 0.4)
    assert sorted(map(tuple, got.collect())) == [("s1", "f", 3, 4), ("s1", "g", 3, 4), ("s3", "h", 2, 4), ("s3", "j", 4, 4)]
    # candidates name sets by the first right that has them
    assert "first" in got._jdf.queryExecution().optimizedPlan().toString()
