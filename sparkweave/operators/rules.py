"""Architecture rules: each turns a graph into findings (rule, severity, node_id, file_path, subject, other_context)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.functions.urls import allowed_key, belonging_keys
from sparkweave.operators.graph import Graph, make_edges
from sparkweave.schema import node_id

#: Rule names, in the order in which findings are reported; an alias means the rule it stands for.
RULES = (
    "views_cannot_import_other_context_models", "react_feature_may_only_call_own_or_shared_api", "serializers_are_the_only_published_contract",
    "no_queryset_in_serializer", "celery_tasks_must_be_idempotent_on_model_pk", "queryset_nplusone", "queryset_missing_index",
    "cascade_crosses_context", "migration_blast_radius", "leaked_seam", "tests_bypass_interface",
)
#: Goes up when a rule changes, so that findings kept of an earlier one don't count.
REVISION = 3
ALIASES = {"async_tasks_must_be_idempotent_on_model_pk": "celery_tasks_must_be_idempotent_on_model_pk"}
BLOCKERS = RULES[:4]
RELATION_TYPES = ("ForeignKey", "OneToOneField", "ManyToManyField", "GenericForeignKey", "GenericRelation")


def extra(key: str, kind: str = "string", column: str = "extra") -> Column:
    """A value of the JSON extras."""
    found = F.get_json_object(column, f"$.{key}")
    return F.from_json(found, kind) if kind.startswith("array") else found.cast(kind)


def findings(rows: DataFrame, rule: str, subject: Column, other_context: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit("blocker" if rule in BLOCKERS else "warning").alias("severity"), "node_id", "file_path", subject.alias("subject"), (F.lit(None).cast("string") if other_context is None else other_context).alias("other_context"))


def _side(nodes: DataFrame, prefix: str, *types: str) -> DataFrame:
    nodes = nodes.where(F.col("type").isin(*types)) if types else nodes
    return nodes.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("id", "type", "name", "qualified_name", "file_path", "context", "extra")))


def foreign_models(graph: Graph, apps: DataFrame) -> DataFrame:
    """A view or service queries a model of another context. ``apps``: app, context; for models without one."""
    e = graph.edges_of("queries_model").select(F.col("src").alias("s_id"), F.col("dst").alias("m_id"))
    rows = e.join(_side(graph.nodes, "s", "django.view", "django.service"), "s_id").join(_side(graph.nodes, "m"), "m_id")
    rows = rows.withColumn("app", F.when(F.col("m_context").isNull(), F.substring_index("m_qualified_name", ".", 1))).join(apps.withColumnRenamed("context", "app_context"), "app", "left")
    rows = rows.withColumn("other", F.coalesce("m_context", "app_context")).where("s_context <> other")
    return findings(rows.withColumnsRenamed({"s_id": "node_id", "s_file_path": "file_path"}), RULES[0], F.col("m_qualified_name"), F.col("other"))


def foreign_apis(graph: Graph, apis: DataFrame) -> DataFrame:
    """UI code calls an API that another context has published, and its own has not. ``apis``: context, path, in order (pos).

    A URL belongs to a published path by one of a few keys, the paths above it, so calls meet APIs by equal keys.
    """
    e = graph.edges_of("calls", "consumed_by_client").select(F.col("src").alias("s_id"), F.col("dst").alias("c_id"))
    rows = e.join(_side(graph.nodes, "s", "react.feature", "react.hook", "react.page", "react.component"), "s_id").join(_side(graph.nodes, "c", "react.api_client"), "c_id")
    rows = rows.where("s_context is not null").join(apis.select(F.col("context").alias("s_context")).distinct(), "s_context", "left_semi").dropDuplicates(["s_id", "c_id"])
    published = apis.select("context", "pos", allowed_key(F.col("path")).alias("key"))
    # each URL once, however many places call it
    urls = rows.select("c_name").distinct().select("c_name", F.explode(belonging_keys(F.col("c_name"))).alias("key"))
    owners = urls.join(published, "key").groupBy("c_name", "context").agg(F.min("pos").alias("pos"))
    by = rows.select("s_id", "c_id", "s_context", "s_file_path", "c_name").join(owners, "c_name").groupBy("s_id", "c_id", "s_context", "s_file_path", "c_name").agg(F.bool_or(F.col("context") == F.col("s_context")).alias("own"), F.min_by("context", "pos").alias("other"))
    return findings(by.where("not own").withColumnsRenamed({"s_id": "node_id", "s_file_path": "file_path"}), RULES[1], F.col("c_name"), F.col("other"))


def contract_drift(graph: Graph) -> DataFrame:
    """A form still holds fields that the serializer it is matched with lacks.

    A form is compared once with each set of fields that its serializers have, of which the smallest serializer with it
    stands for all; as many findings follow as there are such serializers.
    """
    e = graph.edges_of("matches_schema").select(F.col("src").alias("s_id"), F.col("dst").alias("f_id"))
    fields = graph.of_types("django.serializer_field").select(F.col("name").alias("field"), F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("s_qualified_name"))
    has = fields.groupBy("s_qualified_name").agg(F.sort_array(F.collect_set("field")).alias("has"))
    sets = _side(graph.nodes, "s", "django.serializer").select("s_id", "s_qualified_name").join(has, "s_qualified_name", "left").select("s_id", F.coalesce("has", F.array().cast("array<string>")).alias("has"))
    first = sets.groupBy("has").agg(F.min("s_id").alias("first"))
    pairs = e.join(sets.join(first, "has").select("s_id", "first"), "s_id").groupBy("f_id", "first").agg(F.count("*").alias("n"))
    rows = pairs.join(first, "first").join(_side(graph.nodes, "f", "react.form_schema"), "f_id")
    rows = rows.withColumn("more", F.array_except(F.coalesce(extra("fields", "array<string>", "f_extra"), F.array().cast("array<string>")), "has")).where("size(more) > 0")
    rows = rows.select("f_id", "f_file_path", F.array_join(F.sort_array("more"), ",").alias("lacking"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return findings(rows.withColumnsRenamed({"f_id": "node_id", "f_file_path": "file_path"}), RULES[2], F.col("lacking"))


def queryset_in_serializer(graph: Graph) -> DataFrame:
    rows = graph.of_types("django.serializer").where(extra("queryset_in_serializer", "boolean"))
    return findings(rows.withColumnRenamed("id", "node_id"), RULES[3], F.col("name"))


def task_idempotency(graph: Graph) -> DataFrame:
    """Tasks none of whose arguments looks like a key; not those that are only referenced."""
    keyed = extra("looks_idempotent_on_pk", "boolean")
    rows = graph.of_types("django.task").where(~F.coalesce(keyed, F.lit(False)) & (F.size(F.coalesce(extra("args", "array<string>"), F.array().cast("array<string>"))) > 0))
    rows = rows.where(~(F.coalesce(extra("referenced", "boolean"), F.lit(False)) & keyed.isNull()))
    return findings(rows.withColumnRenamed("id", "node_id"), RULES[4], F.col("name"))


def _fields(graph: Graph) -> DataFrame:
    f = graph.of_types("django.field")
    relation = F.coalesce(extra("relation", "boolean"), F.lit(False)) | F.coalesce(extra("field_type").isin(*RELATION_TYPES), F.lit(False))
    covered = F.coalesce(extra("db_index", "boolean"), F.lit(False)) | F.coalesce(extra("unique", "boolean"), F.lit(False)) | F.coalesce(extra("field_type").isin(*RELATION_TYPES[:3]), F.lit(False))
    return f.select(F.col("name").alias("field"), extra("app").alias("field_app"), F.col("qualified_name").alias("field_name"), relation.alias("relation"), covered.alias("covered"))


def _scoped(uses: DataFrame, fields: DataFrame) -> DataFrame:
    """Uses with what the rules read of the fields of that name: those of the owner's app if there are any, else all.

    Fields of one name are combined before uses meet them, by app and over all apps, so that a use stays one row: whether
    one of them is a relation, and the first without an index or, if all have one, the first.
    """
    def combined(*by: str) -> DataFrame:
        return fields.groupBy(*by).agg(F.struct(F.bool_or("relation").alias("relation"), F.min(F.when(~F.col("covered"), F.col("field_name"))).alias("bare_name"), F.min("field_name").alias("field_name")).alias("of_" + by[-1]))

    own = combined("field", "field_app").withColumnRenamed("field_app", "app")
    rows = uses.join(own, ["app", "field"], "left").join(combined("field"), "field", "left").withColumn("of", F.coalesce("of_field_app", "of_field"))
    return rows.select(*uses.columns, "of.relation", F.coalesce("of.bare_name", "of.field_name").alias("field_name"), F.col("of.bare_name").isNull().alias("covered"))


def nplusone(graph: Graph) -> DataFrame:
    """Loops over a queryset that touch relations, or names that no field has."""
    hits = graph.nodes.select(F.col("id").alias("node_id"), "file_path", extra("app").alias("app"), F.posexplode(F.from_json(F.get_json_object("extra", "$.nplusone"), "array<struct<line:int,loop_var:string,accessed:array<string>>>")).alias("hit", "h"))
    uses = hits.select("node_id", "file_path", "app", "hit", F.explode("h.accessed").alias("field"))
    kept = _scoped(uses, _fields(graph)).where("relation or field_name is null")
    rows = kept.groupBy("node_id", "file_path", "hit").agg(F.array_join(F.sort_array(F.collect_set("field")), ",").alias("touched"))
    return findings(rows, RULES[5], F.col("touched"))


def missing_index(graph: Graph) -> DataFrame:
    """Lookups by a field that has no index."""
    hits = graph.nodes.select(F.col("id").alias("node_id"), "file_path", extra("app").alias("app"), F.posexplode(F.from_json(F.get_json_object("extra", "$.lookups"), "array<struct<kind:string,fields:array<string>,line:int>>")).alias("hit", "h"))
    uses = hits.select("node_id", "file_path", "app", "hit", F.explode("h.fields").alias("field"))
    bare = _scoped(uses, _fields(graph)).where("field_name is not null and not covered")
    rows = bare.groupBy("node_id", "file_path", "hit", "field").agg(F.min("field_name").alias("sample"))
    return findings(rows, RULES[6], F.concat_ws(" ", "field", "sample"))


def cascades(graph: Graph, apps: DataFrame) -> DataFrame:
    """Deleting a row of one context deletes rows of another."""
    e = graph.edges_of("relates_to").where(extra("on_delete") == "CASCADE").select(F.col("src").alias("s_id"), F.col("dst").alias("t_id"))
    rows = e.join(_side(graph.nodes, "s", "django.field"), "s_id").join(_side(graph.nodes, "t"), "t_id")
    for side in ("s", "t"):
        own = apps.select(F.col("app").alias(f"{side}_app"), F.col("context").alias(f"{side}_by_app"))
        rows = rows.withColumn(f"{side}_app", F.coalesce(extra("app", column=f"{side}_extra"), F.substring_index(f"{side}_qualified_name", ".", 1))).join(own, f"{side}_app", "left")
        rows = rows.withColumn(f"{side}_in", F.coalesce(f"{side}_context", f"{side}_by_app"))
    return findings(rows.where("s_in <> t_in").withColumnsRenamed({"s_id": "node_id", "s_file_path": "file_path"}), RULES[7], F.col("t_qualified_name"))


def blast_radius(graph: Graph, shown: int | None = 8) -> DataFrame:
    """Migrations that drop a field or model to which something still refers; the finding names the first ``shown`` of these, or all.

    Where numbers stand for ids, nodes have a ``label``, which says what an id of text says.
    """
    ops = graph.of_types("django.migration_op").select(F.col("id").alias("node_id"), "file_path", extra("op").alias("op"), extra("app").alias("app"), extra("model_name").alias("model"), extra("field_name").alias("field"), extra("args", "array<string>").alias("args"))
    ops = ops.withColumn("model", F.coalesce("model", F.get("args", F.lit(0)))).withColumn("field", F.coalesce("field", F.get("args", F.lit(1)))).where("model is not null")
    ops = ops.withColumn("of_model", F.lower(F.concat_ws(".", "app", "model")))
    names = graph.nodes.select(F.col("id").alias("ref"), "type", F.lower("qualified_name").alias("low"), "name")
    # a model is named by its id's second part, whichever type the edge's author took it for
    labelled = "label" in graph.nodes.columns
    e = graph.edges_of("serializes", "queries_model", "relates_to").select("src", "type", "dst")
    ends = graph.nodes.select(F.col("id").alias("dst"), "label") if labelled else e.select("dst", F.col("dst").alias("label")).distinct()
    # dropped models meet the nodes they may be, of which there are fewer than edges
    ops = ops.join(ends.select("dst", F.lower(F.substring_index("label", ":", -1)).alias("of_model")), "of_model", "left")
    drop_field, drop_model = ops.where("op = 'RemoveField' and field is not null"), ops.where("op = 'DeleteModel'")
    own_field = drop_field.withColumn("low", F.concat_ws(".", "of_model", F.lower("field"))).join(names.where("type = 'django.field'").select("ref", "low"), "low")
    of_model = drop_field.join(e.where("type = 'serializes'").select("dst", F.col("src").alias("serializer")), "dst")
    # a serializer's fields have their names before they meet the models it serves: not each with all of them
    children = graph.edges_of("has_field").select(F.col("src").alias("serializer"), F.col("dst").alias("ref")).join(names.select("ref", F.col("name").alias("field")), "ref")
    served = of_model.join(children, ["serializer", "field"])
    own_model = drop_model.withColumn("low", F.col("of_model")).join(names.where("type = 'django.model'").select("ref", "low"), "low")
    users = drop_model.join(e.select("dst", F.col("src").alias("ref")), "dst").join(names.select("ref"), "ref", "left_semi")
    still = own_field.select("node_id", "file_path", "ref")
    for part in (served, own_model, users):
        still = still.unionByName(part.select("node_id", "file_path", "ref"))
    if labelled:
        still = still.join(graph.nodes.select(F.col("id").alias("ref"), "label"), "ref", "left").drop("ref").withColumnRenamed("label", "ref")
    refs = F.sort_array(F.collect_set("ref"))
    rows = still.groupBy("node_id", "file_path").agg(F.array_join(refs if shown is None else F.slice(refs, 1, shown), ",").alias("refs"))
    return findings(rows, RULES[8], F.col("refs"))


def leaked_seams(graph: Graph) -> DataFrame:
    """A view queries a model though its context has a query module in another file."""
    e = graph.edges_of("queries_model").where(~F.coalesce(extra("imported", "boolean"), F.lit(False))).select(F.col("src").alias("v_id"), F.col("dst").alias("m_id")).distinct()
    rows = e.join(_side(graph.nodes, "v", "django.view"), "v_id").join(_side(graph.nodes, "m", "django.model"), "m_id").where("v_context is not null and v_context <> ''")
    peers = graph.of_types("django.service").where(~F.coalesce(extra("referenced", "boolean"), F.lit(False)) & F.col("file_path").isNotNull() & F.coalesce(F.col("context") != "", F.lit(False)))
    peers = peers.select(F.col("id").alias("p_id"), F.col("name").alias("p_name"), F.col("file_path").alias("p_file"), F.col("context").alias("v_context"))
    # the module that queries the same model, if there is one: few services query a model
    same = graph.edges_of("queries_model").select(F.col("src").alias("p_id"), F.col("dst").alias("m_id")).join(peers, "p_id").distinct()
    named = rows.join(same.select("m_id", "v_context", "p_name", "p_file"), ["m_id", "v_context"]).where("p_file <> coalesce(v_file_path, '')")
    named = named.groupBy("v_id", "m_id").agg(F.min("p_name").alias("peer"))
    # else a file of the context with services, the first that isn't the view's own; one with a service that
    # the view does not call before one without. It stands among the first k + 2 files of the context, if
    # the view calls into k of them
    calls = graph.edges_of("calls").select(F.col("src").alias("v_id"), F.col("dst").alias("p_id"))
    views = rows.select("v_id", "v_context", "v_file_path").distinct()
    called = views.join(calls, "v_id").join(peers, ["p_id", "v_context"]).groupBy("v_id", "v_context", "p_file").agg(F.count_distinct("p_id").alias("n_called"))
    files = peers.groupBy("v_context", "p_file").agg(F.count("*").alias("n_services")).withColumn("nth", F.row_number().over(Window.partitionBy("v_context").orderBy("p_file")))
    views = views.join(called.groupBy("v_id").agg(F.count("*").alias("k")), "v_id", "left").withColumn("nth", F.explode(F.sequence(F.lit(1), (F.coalesce("k", F.lit(0)) + 2).cast("int"))))
    options = views.join(files, ["v_context", "nth"]).where("p_file <> coalesce(v_file_path, '')")
    options = options.join(called, ["v_id", "v_context", "p_file"], "left").withColumn("free", F.coalesce("n_called", F.lit(0)) < F.col("n_services"))
    module = options.groupBy("v_id").agg(F.coalesce(F.min(F.when(F.col("free"), F.col("p_file"))), F.min("p_file")).alias("p_file"))
    module = module.select("v_id", F.regexp_replace(F.substring_index("p_file", "/", -1), r"\.[^.]*$", "").alias("module"))
    rows = rows.join(named, ["v_id", "m_id"], "left").join(module, "v_id").withColumn("peer", F.coalesce("peer", "module"))
    return findings(rows.withColumnsRenamed({"v_id": "node_id", "v_file_path": "file_path"}), RULES[9], F.concat_ws(" ", "m_qualified_name", "peer"))


def bypassed_interfaces(graph: Graph) -> DataFrame:
    """Routes without a test whose view, serializer or page has one.

    Of several views, pages or serializers the last counts. Edges of one node and type are in the order of their other
    ends' ids, or of these ends' labels where numbers stand for ids.
    """
    label = F.col("label" if "label" in graph.nodes.columns else "id").alias("last")
    tested = graph.edges_of("tested_by").select(F.col("src").alias("id")).distinct()
    routes = graph.of_types("django.route", "react.route").select("id", "file_path").join(tested, "id", "left_anti")
    published = graph.edges_of("publishes_route").select(F.col("src").alias("id"), F.col("dst").alias("behind"))
    kinds = graph.of_types("django.view", "react.page", "django.serializer").select(F.col("id").alias("behind"), "type", "name", label)
    behind = routes.join(published, "id").join(kinds.where("type <> 'django.serializer'"), "behind")
    behind = behind.groupBy("id", "file_path", "type").agg(F.max_by("behind", "last").alias("behind"))
    serializers = graph.edges_of("uses_serializer").select(F.col("src").alias("view"), F.col("dst").alias("behind")).join(kinds.where("type = 'django.serializer'").select("behind", "last"), "behind")
    serializers = serializers.groupBy("view").agg(F.max_by("behind", "last").alias("serializer"))
    views = behind.where("type = 'django.view'").select("id", "file_path", F.col("behind").alias("view")).join(serializers, "view").select("id", "file_path", F.col("serializer").alias("behind"))
    every = behind.select("id", "file_path", "behind").unionByName(views).join(tested.withColumnRenamed("id", "behind"), "behind", "left_semi").join(kinds.select("behind", "name"), "behind")
    rows = every.groupBy("id", "file_path").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("tested"))
    return findings(rows.withColumnRenamed("id", "node_id"), RULES[10], F.col("tested"))


def waive(found: DataFrame, waivers: DataFrame) -> DataFrame:
    """``waived``: some waiver (rule, node) has the rule, and the finding's node or none. Aliases count as their rule."""
    mapping = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    w = waivers.select(F.coalesce(mapping[F.col("rule")], F.col("rule")).alias("rule"), "node")
    whole = w.where("node is null").select("rule").distinct().withColumn("all", F.lit(True))
    single = w.where("node is not null").select("rule", F.col("node").alias("node_id")).distinct().withColumn("one", F.lit(True))
    rows = found.join(whole, "rule", "left").join(single, ["rule", "node_id"], "left")
    return rows.select(*found.columns, (F.coalesce("all", F.lit(False)) | F.coalesce("one", F.lit(False))).alias("waived"))


def crossing_edges(found: DataFrame) -> DataFrame:
    """``crosses_context`` edges of findings that aren't waived: to be united with the graph's."""
    rows = found.where("not waived and node_id is not null and other_context is not null")
    return make_edges(rows.select(F.col("node_id").alias("src"), node_id("arch.context", F.col("other_context")).alias("dst"), F.lit("crosses_context").alias("type")).distinct())


def evaluate(graph: Graph, apps: DataFrame, apis: DataFrame | None = None, rules: tuple[str, ...] = RULES, waivers: DataFrame | None = None) -> DataFrame:
    """Findings of the enabled rules, with ``waived``."""
    enabled = {ALIASES.get(r, r) for r in rules}
    make = {
        RULES[0]: lambda: foreign_models(graph, apps), RULES[2]: lambda: contract_drift(graph), RULES[3]: lambda: queryset_in_serializer(graph),
        RULES[4]: lambda: task_idempotency(graph), RULES[5]: lambda: nplusone(graph), RULES[6]: lambda: missing_index(graph), RULES[7]: lambda: cascades(graph, apps),
        RULES[8]: lambda: blast_radius(graph), RULES[9]: lambda: leaked_seams(graph), RULES[10]: lambda: bypassed_interfaces(graph),
    }
    if apis is not None:
        make[RULES[1]] = lambda: foreign_apis(graph, apis)
    frames = [make[r]() for r in RULES if r in enabled and r in make]
    found = frames[0]
    for f in frames[1:]:
        found = found.unionByName(f)
    return found.withColumn("waived", F.lit(False)) if waivers is None else waive(found, waivers)


# How strongly a recommendation is meant, by rule.
STRENGTH = {"leaked_seam": "strong", "tests_bypass_interface": "worth_exploring", "queryset_nplusone": "worth_exploring"}


def deepening_cards(found: DataFrame, limit: int = 8) -> DataFrame:
    """Recommendations from findings of three rules, the strongest first; the first is marked."""
    strength = F.create_map(*(F.lit(x) for pair in STRENGTH.items() for x in pair))
    cards = found.where(~F.col("waived") & F.col("rule").isin(*STRENGTH)).select("rule", "node_id", "file_path", "subject", strength[F.col("rule")].alias("strength")).dropDuplicates(["rule", "node_id", "subject"])
    rank = F.when(F.col("strength") == "strong", 0).when(F.col("strength") == "worth_exploring", 1).otherwise(2)
    first = cards.orderBy(rank, "rule", "subject", "node_id").limit(limit)
    w = Window.orderBy(rank, "rule", "subject", "node_id")  # over at most ``limit`` rows
    return first.withColumn("position", F.row_number().over(w)).withColumn("top", F.col("position") == 1)
