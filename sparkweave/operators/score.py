"""Scores of an impact set: coverage, confidence, kinds of change, contract, roles and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.operators.graph import Graph
from sparkweave.operators.rules import extra
from sparkweave.operators.traverse import walk
from sparkweave.schema import CONTRACT_TYPES, HUB_TYPES, INFERRED_BELOW, SINK_TYPES

TEST_TYPES = ("django.test", "react.test")
#: Confidence of a client that a generated one supersedes.
SUPERSEDED = 0.4


def tested_ids(impact: Graph) -> DataFrame:
    """id of impact nodes that a test of the impact set tests."""
    ids = impact.nodes.select("id")
    e = impact.edges_of("tested_by").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select(F.col("src").alias("id")).distinct()


def sink_coverage(impact: Graph, hops: int = 2) -> DataFrame:
    """id, type, name, covered of every sink: it is covered if something tested lies within some undirected hops."""
    ids = impact.nodes.select("id")
    e = impact.edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    steps = e.select(F.explode(F.array(F.struct(F.col("src").alias("n"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("n"), F.col("src").alias("other")))).alias("s")).select("s.*", F.lit(True).alias("expand"))
    near = walk(steps, tested_ids(impact), hops, edges=False)[0].select("id")
    sinks = impact.of_types(*SINK_TYPES).select("id", "type", "name")
    return sinks.join(near.withColumn("covered", F.lit(True)), "id", "left").select("id", "type", "name", F.coalesce("covered", F.lit(False)).alias("covered"))


def confidence_level(sinks: Column, covered: Column, blockers: Column, warnings: Column, inferred: Column, edges: Column, residuals: Column) -> Column:
    """The ladder: low, medium or high. Ratios are compared as products of whole numbers."""
    low = (blockers > 0) | ((sinks > 0) & (covered * 5 < sinks))
    medium = ((sinks > 0) & (covered * 20 < sinks * 17)) | (warnings > 0) | (inferred * 20 > edges * 7) | (residuals > 0)
    return F.when(low, "low").when(medium, "medium").otherwise("high")


def score_confidence(impact: Graph, found: DataFrame, residuals: int = 0, counted: DataFrame | None = None) -> DataFrame:
    """One row: counts, level and score.

    ``counted``: type, confidence, n of all edges of the impact set, which then needs to hold only those that tell coverage.
    """
    s = sink_coverage(impact).agg(F.count("*").alias("sinks"), F.count_if("covered").alias("covered_sinks"))
    counted = impact.edges.select("confidence", F.lit(1).cast("bigint").alias("n")) if counted is None else counted
    e = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.when(F.col("confidence") < INFERRED_BELOW, F.col("n"))), F.lit(0)).alias("inferred_edges"))
    f = found.where(~F.col("waived")).agg(F.count_if(F.col("severity") == "blocker").alias("blockers"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    row = s.crossJoin(e).crossJoin(f).withColumn("residuals", F.lit(residuals))  # one row each
    level = confidence_level(*(F.col(c) for c in ("sinks", "covered_sinks", "blockers", "warnings", "inferred_edges", "edges", "residuals")))
    ratio = F.when(F.col("sinks") == 0, 1.0).otherwise(F.col("covered_sinks") / F.col("sinks"))
    inferred = F.when(F.col("edges") == 0, 0.0).otherwise(F.col("inferred_edges") / F.col("edges"))
    return row.withColumn("level", level).withColumn("score", F.round(ratio - 0.15 * F.col("blockers") - 0.05 * inferred, 3))


# Types by which a change's seeds tell its kind, and types that only show.
MIGRATING_TYPES = ("django.migration_op", "django.model", "django.field")
UI_TYPES = ("react.component", "react.page", "react.route", "react.test", "react.feature")
CROSSING_RULES = ("views_cannot_import_other_context_models", "react_feature_may_only_call_own_or_shared_api")


def classify_change(impact: Graph, found: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """kind: the kinds of change that the seeds (all impact nodes, if there are none), the impact set and findings make."""
    def any_type(*types: str) -> Column:
        return F.coalesce(F.bool_or(F.col("type").isin(*types)), F.lit(False))

    def flags(nodes: DataFrame, prefix: str) -> DataFrame:
        return nodes.agg(F.count("*").alias(f"{prefix}_n"), any_type(*CONTRACT_TYPES).alias(f"{prefix}_contract"), any_type(*MIGRATING_TYPES).alias(f"{prefix}_migration"), any_type("django.permission").alias(f"{prefix}_auth"))

    of_impact = impact.nodes.agg(
        any_type("django.service").alias("service"), any_type("react.component", "react.page").alias("shows"), any_type("react.hook").alias("hook"),
        (F.count("*") > 0).alias("some"), F.coalesce(F.bool_and(F.col("type").isin(*UI_TYPES)), F.lit(False)).alias("only_ui"),
    )
    crossing = found.agg(F.coalesce(F.bool_or(F.col("rule").isin(*CROSSING_RULES) & ~F.col("waived")), F.lit(False)).alias("crossing"))
    row = of_impact.crossJoin(flags(impact.nodes, "i")).crossJoin(crossing)  # one row each
    row = row.crossJoin(flags(seeds if seeds is not None else impact.nodes, "s"))

    def told(name: str) -> Column:
        return F.when(F.col("s_n") > 0, F.col(f"s_{name}")).otherwise(F.col(f"i_{name}"))

    kinds = F.array_compact(F.array(F.when(told("auth"), "auth"), F.when(F.col("crossing"), "cross_context"), F.when(told("contract"), "public_contract"), F.when(told("migration"), "schema_migration")))
    kinds = F.when(F.col("service") & ~told("contract"), F.array_append(kinds, F.lit("internal_service"))).otherwise(kinds)
    leaf = (F.col("some") & F.col("only_ui")) | (F.col("shows") & ~F.col("hook"))
    kinds = F.when(F.size(kinds) > 0, kinds).when(leaf, F.array(F.lit("leaf_ui"))).otherwise(F.array(F.lit("internal_service")))
    return row.select(F.explode(kinds).alias("kind"))


def is_low_risk(kinds: Column, level: Column, blockers: Column) -> Column:
    risky = F.exists(kinds, lambda k: k.isin("cross_context", "public_contract", "schema_migration", "auth"))
    return (blockers == 0) & (level != "low") & ~risky & ((level == "high") | F.array_contains(kinds, "leaf_ui"))


def gate(level: Column, blockers: Column, contract: Column, fail_on: str = "blocker") -> Column:
    """Exit code for CI: 2 for blockers, then 4 for a breaking contract, then 3 for too low a confidence."""
    if fail_on == "never":
        return F.lit(0)
    code = F.when(blockers > 0, 2)
    if fail_on in ("low", "medium"):
        code = code.when(contract == "breaking", 4).when(level.isin(*("low", "medium")[: 1 + (fail_on == "medium")]), 3)
    return code.otherwise(0)


def contract_break(impact: Graph, diff: DataFrame) -> DataFrame:
    """One row, kind and fields: whether a change (path, patch) breaks, drifts from or adds to the published contract."""
    lines = diff.select("path", F.explode(F.split("patch", "\n")).alias("text"))
    quoted = F.regexp_extract_all("text", F.lit("['\"](\\w+)['\"]"), 1)
    listed = F.regexp_extract("text", "^[+-]\\s*['\"](\\w+)['\"]\\s*,?\\s*$", 1)
    plus = F.col("text").startswith("+")
    required = F.when(plus & F.col("text").rlike("required.*True"), F.filter(quoted, lambda q: ~q.isin("extra_kwargs", "required")))
    nothing = F.array().cast("array<string>")
    sets = lines.agg(
        F.array_distinct(F.flatten(F.collect_list(F.coalesce(required, nothing)))).alias("required"),
        F.collect_set(F.when(~plus & (listed != ""), listed)).alias("removed"), F.collect_set(F.when(plus & (listed != ""), listed)).alias("added"),
    )
    touched = impact.nodes.join(diff.select(F.col("path").alias("file_path")).distinct().withColumn("touched", F.lit(True)), "file_path", "left")

    def moved(*types: str) -> Column:
        return F.coalesce(F.bool_or(F.col("type").isin(*types) & F.coalesce("touched", F.lit(False))), F.lit(False))

    of_type = lambda *types: F.col("type").isin(*types)
    flags = touched.agg(
        F.coalesce(F.bool_or(of_type(*CONTRACT_TYPES)), F.lit(False)).alias("some"), moved("django.serializer", "django.serializer_field", "fastapi.model").alias("serializer"),
        moved("graphql.type", "graphql.field", "graphql.operation").alias("graphql"), moved("openapi.path").alias("openapi"), moved("react.form_schema").alias("form"),
        F.collect_set(F.when(of_type("django.serializer_field", "django.field"), F.col("name"))).alias("served"),
        F.array_distinct(F.flatten(F.collect_list(F.when(of_type("react.form_schema"), F.coalesce(extra("fields", "array<string>"), nothing)).otherwise(nothing)))).alias("posted"),
    )
    row = sets.crossJoin(flags)  # one row each
    missing = F.array_except(F.array_except("served", "posted"), F.array(F.lit("id"), F.lit("pk")))
    breaking = (F.size("required") > 0) | (F.col("serializer") & (F.size("removed") > 0)) | (F.col("graphql") & F.col("serializer"))
    drift = F.col("serializer") & (F.col("openapi") | (F.col("form") & (F.size(missing) > 0)))
    kind = F.when(~F.col("some"), "none").when(breaking, "breaking").when(drift, "drift").otherwise("additive")
    gained = F.when(F.col("serializer") & ~breaking, F.col("added")).otherwise(nothing)
    lost = F.when(F.col("serializer"), F.col("removed")).otherwise(nothing)
    fields = F.array_distinct(F.concat("required", F.sort_array(lost), F.sort_array(gained), F.when(F.col("form") & F.col("serializer"), F.sort_array(missing)).otherwise(nothing)))
    return row.select(kind.alias("kind"), F.when(F.col("some"), F.slice(fields, 1, 12)).otherwise(nothing).alias("fields"))


def untested_fields(impact: Graph, names: DataFrame) -> DataFrame:
    """type, name of changed fields (``names``: name) on the path that no test there mentions."""
    said = impact.of_types(*TEST_TYPES).select(F.explode(extra("mentions", "array<string>")).alias("name")).distinct()
    fields = impact.of_types("django.field", "django.serializer_field").where(~F.col("name").isin("id", "pk")).select("type", "name").distinct()
    return fields.join(names.select("name").distinct(), "name", "left_semi").join(said, "name", "left_anti").select("type", "name")


def path_residuals(impact: Graph) -> DataFrame:
    """kind, node_id, what: what the walk can't vouch for on its way.

    One scan of the nodes and one of the edges: each row gives an array of tagged structs, of which those that hold
    are kept, whatever number of kinds there is.
    """
    def tagged(**kinds: Column) -> Column:
        return F.filter(F.array(*(F.when(when, F.struct(F.lit(kind).alias("kind"), what.alias("what"))) for kind, (when, what) in kinds.items())), lambda x: x.isNotNull())

    flag = lambda key: F.coalesce(extra(key, "boolean"), F.lit(False))
    name, place = F.col("qualified_name"), F.coalesce(F.concat_ws(":", "file_path", F.col("start_line").cast("string")), F.col("qualified_name")) if "start_line" in impact.nodes.columns else F.coalesce("file_path", "qualified_name")
    hits = F.from_json(F.get_json_object("extra", "$.nplusone"), "array<struct<line:int,loop_var:string,accessed:array<string>>>")
    tested = impact.edges_of("tested_by").select(F.col("src").alias("id")).distinct().withColumn("tested", F.lit(True))
    nodes = impact.nodes.join(tested, "id", "left")
    of_node = tagged(
        untested_receiver=((F.col("type") == "django.receiver") & F.col("tested").isNull(), F.concat(F.lit("no test: "), "name", F.lit(" "), place)),
        dynamic_serializer=(flag("get_serializer_class") & (F.size(F.coalesce(extra("serializer_classes", "array<string>"), F.array().cast("array<string>"))) == 0), F.concat(F.lit("serializer chosen at run time: "), name)),
        string_reference=(flag("string_ref"), F.concat(F.lit("model named by a string: "), name)),
        inferred_node=(flag("inferred"), F.concat(F.lit("inferred: "), "name")),
        queryset=(flag("queryset_in_serializer"), F.concat(F.lit("queryset inside a serializer: "), name)),
    )
    loops = F.transform(hits, lambda h: F.struct(F.lit("nplusone").alias("kind"), F.concat(F.lit("queries in a loop: "), F.array_join(F.array_sort(h["accessed"]), ","), F.lit(" in "), F.coalesce("file_path", F.lit("?")), F.lit(":"), h["line"].cast("string")).alias("what")))
    rows = nodes.select(F.col("id").alias("node_id"), F.explode(F.concat(of_node, F.coalesce(loops, F.array().cast("array<struct<kind:string,what:string>>")))).alias("r"))
    unsure = F.col("confidence") < INFERRED_BELOW
    ends = F.concat_ws(" ", "type", "src", "dst")
    of_edge = tagged(
        overlap=((F.col("type") == "matches_schema") & unsure, F.concat(F.lit("inferred from shared fields: "), "src", F.lit(" and "), "dst")),
        superseded=((F.col("type") == "consumed_by_client") & (F.col("confidence") == SUPERSEDED), F.concat(F.lit("a generated client covers "), "dst")),
        inferred_edge=(~F.col("type").isin("matches_schema") & unsure & (F.col("confidence") != SUPERSEDED), F.concat(F.lit("inferred: "), ends)),
    )
    edges = impact.edges.select(F.col("dst").alias("node_id"), F.explode(of_edge).alias("r"))
    return rows.unionByName(edges).select("r.kind", "node_id", "r.what").distinct()


def ui_residuals(impact: Graph, paths: DataFrame, names: DataFrame) -> DataFrame:
    """what: mutations that leave queries stale, changed pages without an error boundary, changed fields that no form has."""
    n = impact.nodes
    keys = n.agg(
        F.count_if(F.col("type") == "react.query_key").alias("keys"), F.count_if((F.col("type") == "react.query_key") & F.coalesce(extra("invalidation", "boolean"), F.lit(False))).alias("fresh"),
        F.count_if((F.col("type") == "react.hook") & (F.coalesce(extra("mutation", "boolean"), F.lit(False)) | F.col("name").contains("Mutation"))).alias("mutations"),
    )
    stale = keys.where("keys > 0 and mutations > 0 and fresh = 0").select(F.lit("a mutation leaves the page's queries stale").alias("what"))
    bare = n.where((F.col("type") == "react.page") & (extra("has_error_boundary", "boolean") == F.lit(False))).join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    forms = n.select(F.explode(F.concat(F.coalesce(extra("form_fields", "array<string>"), F.array().cast("array<string>")), F.when(F.col("type") == "react.form_schema", F.coalesce(extra("fields", "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))).alias("name")).distinct()
    some = forms.limit(1).select(F.lit(True).alias("some"))
    changed = n.where(F.col("type").isin("django.field", "django.serializer_field") & ~F.col("name").isin("id", "pk")).select("name").distinct().join(names.select("name").distinct(), "name", "left_semi")
    absent = changed.join(forms, "name", "left_anti").join(F.broadcast(some))  # one row or none
    return stale.unionByName(bare.select(F.concat(F.lit("no error boundary: "), "name").alias("what"))).unionByName(absent.select(F.concat(F.lit("not in a form: "), "name").alias("what")))


def node_roles(impact: Graph, seeds: DataFrame) -> DataFrame:
    """id, roles (in fixed order) of every node."""
    seed = seeds.select("id").distinct().withColumn("seed", F.lit(True))
    some = seeds.limit(1).agg((F.count("*") > 0).alias("some_seed"))
    tested = impact.edges_of("tested_by").select(F.col("src").alias("id")).distinct().withColumn("tested", F.lit(True))
    weak = impact.edges.where(F.col("confidence") < INFERRED_BELOW)
    weak = weak.select(F.col("src").alias("id")).unionByName(weak.select(F.col("dst").alias("id"))).distinct().withColumn("weak", F.lit(True))
    rows = impact.nodes.select("id", "type", extra("inferred", "boolean").alias("inferred")).join(seed, "id", "left").join(tested, "id", "left").join(weak, "id", "left").crossJoin(some)  # one row
    sink = F.col("type").isin(*SINK_TYPES)
    tags = (
        F.when(F.col("seed"), "seed").when(F.col("some_seed"), "downstream"), F.when(sink, "sink"), F.when(F.col("type").isin(*CONTRACT_TYPES), "contract"),
        F.when(F.col("type").isin(*TEST_TYPES), "test"), F.when(F.col("tested"), "tested").when(sink, "untested"), F.when(F.coalesce("inferred", F.lit(False)) | F.coalesce("weak", F.lit(False)), "inferred"),
    )
    return rows.select("id", F.array_compact(F.array(*tags)).alias("roles"))


def file_marks(impact: Graph, roles: DataFrame) -> DataFrame:
    """path, line, roles, lead of every file: the lead is the first of its roles by importance."""
    rows = impact.nodes.where("file_path is not null").select("id", F.col("file_path").alias("path"), "start_line").join(roles, "id")
    by = rows.groupBy("path").agg(F.min("start_line").alias("line"), F.array_distinct(F.flatten(F.collect_set("roles"))).alias("roles"))
    lead = F.coalesce(*(F.when(F.array_contains("roles", r), r) for r in ("seed", "untested", "contract", "sink", "tested", "downstream")), F.get("roles", F.lit(0)), F.lit("path"))
    return by.select("path", "line", F.sort_array("roles").alias("roles"), lead.alias("lead"))


# Reading order of files by the types they hold.
READ_ORDER = (
    "django.serializer", "django.serializer_field", "django.form", "django.route", "openapi.path", "react.form_schema",
    "django.permission", "django.view", "django.viewset_action", "django.service", "django.model", "django.field",
    "django.migration_op", "django.receiver", "django.signal", "django.task", "react.page", "react.hook",
    "react.api_client", "react.query_key", "react.component", "react.server_action", "django.test", "react.test",
    "graphql.type", "graphql.field", "graphql.operation", "fastapi.route", "fastapi.model", "django.consumer",
    "django.websocket_route", "django.template", "django.htmx", "django.cache_key", "django.feature_flag",
    "django.side_effect",
)


def read_order(paths: DataFrame, nodes: DataFrame, skip: Column) -> DataFrame:
    """path, rank, skip of every changed file; files rank by the first of their types."""
    rank = F.array_position(F.array(*map(F.lit, READ_ORDER)), F.col("type"))
    by = nodes.where("file_path is not null").groupBy(F.col("file_path").alias("path")).agg(F.min(F.when(rank > 0, rank).otherwise(len(READ_ORDER) + 1)).cast("int").alias("rank"))
    return paths.select("path", skip.alias("skip")).join(by, "path", "left").select("path", F.coalesce("rank", F.lit(len(READ_ORDER) + 2)).alias("rank"), "skip")


def contract_sides(fields: DataFrame, limit: int = 40) -> DataFrame:
    """field, server, client, status from rows side (server or client), field."""
    by = fields.where(~F.col("field").isin("id", "pk")).groupBy("field").agg(F.bool_or(F.col("side") == "server").alias("server"), F.bool_or(F.col("side") == "client").alias("client"))
    sides = by.agg(F.coalesce(F.bool_or("server"), F.lit(False)).alias("any_server"), F.coalesce(F.bool_or("client"), F.lit(False)).alias("any_client"))
    status = F.when(F.col("server") & (F.col("client") | ~F.col("any_client")), "aligned").when(F.col("server"), "missing_client").when(F.col("any_server"), "missing_server").otherwise("partial")
    return by.crossJoin(sides).select("field", "server", "client", status.alias("status")).orderBy("field").limit(limit)  # one row


#: Kinds of test by type of sink, what such a test is to show, and its body; {ident} and {name} are filled in.
SKETCHES = {
    "django.route": ("pytest", "Request {name}", "def test_{ident}_is_served(client):\n    assert client.get('{name}').status_code < 400\n"),
    "fastapi.route": ("pytest", "Request {name} of the API", "def test_{ident}_answers(client):\n    assert client.get('{name}').status_code < 500\n"),
    "react.page": ("rtl", "Render {name}", "it('renders {name}', () => {\n  const { container } = render(<{name} />)\n  expect(container.firstChild).not.toBeNull()\n})\n"),
    "react.form_schema": ("rtl", "Submit what {name} accepts", "it('accepts what {name} describes', () => {\n  expect({name}.safeParse(valid).success).toBe(true)\n})\n"),
    "react.route": ("playwright", "Open {name} in a browser", "test('opens {name}', async ({ page }) => {\n  const answer = await page.goto('{name}')\n  expect(answer.ok()).toBeTruthy()\n})\n"),
    "graphql.operation": ("graphql", "Run operation {name}", "def test_{ident}_has_no_errors(run):\n    assert 'errors' not in run('{name}')\n"),
    "django.consumer": ("channels", "Connect to {name}", "async def test_{ident}_accepts(connect):\n    assert await connect('{name}')\n"),
    "django.websocket_route": ("channels", "Open the socket {name}", "async def test_{ident}_opens(connect):\n    assert await connect('{name}')\n"),
    "django.template": ("django", "Render the template {name}", "def test_{ident}_renders():\n    assert render_to_string('{name}', {})\n"),
    "django.cache_key": ("pytest", "Read {name} back after a write", "def test_{ident}_is_cached(write):\n    write()\n    assert cache.get('{name}') is not None\n"),
    "django.feature_flag": ("pytest", "Both sides of the flag {name}", "@pytest.mark.parametrize('on', (False, True))\ndef test_{ident}(client, on, set_flag):\n    set_flag('{name}', on)\n    assert client.get('/').status_code < 500\n"),
    "django.task": ("pytest", "Run the task {name} twice", "def test_{ident}_can_run_twice(run_task, snapshot):\n    run_task('{name}')\n    first = snapshot()\n    run_task('{name}')\n    assert snapshot() == first\n"),
    "django.side_effect": ("pytest", "Nothing of {name} happens on a rollback", "def test_{ident}_waits_for_commit(outbox, rolled_back):\n    rolled_back()\n    assert outbox == []\n"),
}


def suggested_tests(untested: DataFrame, limit: int = 8) -> DataFrame:
    """type, name, test (its name), kind, title, body of a test to write, for each kind and name of untested sink; other types have no sketch."""
    ident = F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_")
    texts = F.create_map(*(x for kind, texts in SKETCHES.items() for x in (F.lit(kind), F.array(*map(F.lit, texts)))))
    rows = untested.dropDuplicates(["type", "name"]).withColumn("sketch", texts[F.col("type")])
    filled = lambda n: F.replace(F.replace(F.get("sketch", F.lit(n)), F.lit("{ident}"), ident), F.lit("{name}"), F.col("name"))
    test = F.format_string("test_%s_%s", F.substring_index("type", ".", -1), ident)
    return rows.orderBy("type", "name").limit(limit).select("type", "name", test.alias("test"), F.get("sketch", F.lit(0)).alias("kind"), filled(1).alias("title"), filled(2).alias("body"))


def sink_summaries(impact: Graph) -> DataFrame:
    shown = F.coalesce(extra("mounted_at"), extra("full_path"), F.col("name"))
    return impact.of_types(*SINK_TYPES).select("id", "type", shown.alias("name"), "file_path", "context", extra("broker").alias("broker"))


def auth_path(impact: Graph) -> DataFrame:
    """view, permissions, guarded of every view on the path."""
    p = impact.edges_of("has_permission").select(F.col("src").alias("id"), F.substring_index("dst", ":", -1).alias("permission"))
    by = p.groupBy("id").agg(F.sort_array(F.collect_set("permission")).alias("permissions"))
    return impact.of_types("django.view").select("id", "name").join(by, "id", "left").select("id", "name", F.coalesce("permissions", F.array().cast("array<string>")).alias("permissions"), F.col("permissions").isNotNull().alias("guarded"))


def suggested_reviewers(impact: Graph, owners: DataFrame) -> DataFrame:
    """owner, first: owners (context, owner, pos) of the contexts on the path, by where they first stand."""
    contexts = impact.nodes.where("context is not null").select("context").distinct()
    return owners.join(contexts, "context", "left_semi").groupBy("owner").agg(F.min(F.struct("context", "pos")).alias("first")).select("owner", F.col("first.context").alias("context"))


def title_of(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """cluster, title, files, seeds: the title is the member whose type comes first."""
    rank = F.array_position(F.array(*map(F.lit, READ_ORDER)), F.col("type"))
    rows = clusters.join(nodes.select("id", "type", "name", "file_path"), "id")
    by = F.struct(F.when(rank > 0, rank).otherwise(99), "name")
    return rows.groupBy("cluster").agg(F.min_by("name", by).alias("title"), F.count_distinct("file_path").alias("files"), F.count("*").alias("seeds"))


def related_nodes(members: DataFrame, impact: DataFrame) -> DataFrame:
    """Members, and sinks that share the first part of a member's qualified name."""
    first = F.substring_index("qualified_name", ".", 1)
    heads = members.select(first.alias("head")).distinct()
    sinks = impact.where(F.col("type").isin(*SINK_TYPES)).withColumn("head", first).join(heads, "head", "left_semi").select("id")
    return members.select("id").unionByName(sinks).distinct()


def without_hubs(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("type").isin(*HUB_TYPES))


# Types that an overview leaves out.
DETAIL_TYPES = ("django.field", "django.serializer_field", "graphql.field", "django.viewset_action", "react.query_key", "django.url_name")


def visible_nodes(nodes: DataFrame, families: list[str], overview: bool = False) -> DataFrame:
    """Nodes of some families, of an overview without details."""
    nodes = nodes.where(F.substring_index("type", ".", 1).isin(*families))
    return nodes.where(~F.col("type").isin(*DETAIL_TYPES)) if overview else nodes


def visible_graph(graph: Graph, families: list[str], overview: bool = False, focus: str | None = None) -> Graph:
    """Nodes of some families (of an overview without details), around a node if one is in focus, and their edges."""
    shown = graph.induced(visible_nodes(graph.nodes, families, overview))
    if focus is None:
        return shown
    at = shown.neighbors(focus)
    near = at.select(F.col("src").alias("id")).unionByName(at.select(F.col("dst").alias("id"))).distinct()
    return shown.induced(near)
