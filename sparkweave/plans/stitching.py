"""Stitching a graph's halves as *links*: entities that look for providers under shared keys.

What a link finds for an entity follows from the entity and from the providers that share one of its keys, and
from nothing else. So a whole index is stitched by joins over all nodes, and a changed one by the same joins over
the nodes that share keys with what changed (``sparkweave.plans.live``). ``keys_of`` says which keys these are.

A route's path follows from the include of its app, a contract's fields from its field nodes: these are links
whose entity is derived (``DERIVED``), and a change of a provider is a change of the entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.paths import glob_pattern
from sparkweave.functions.urls import e2e_template, let, match_key, mounted_key, normalize_url, route_template
from sparkweave.operators import stitch
from sparkweave.operators.graph import Graph, make_edges
from sparkweave.operators.rules import extra
from sparkweave.schema import node_id

DERIVED = ("include", "field")
ROUTES = ("django.route", "fastapi.route", "django.websocket_route")
CONTRACTS = ("django.serializer", "fastapi.model", "graphql.type")
#: Of edges that several links give, the one of the last link counts.
LINKS = ("client", "operation", "published", "schema", "graphql", "htmx", "visit", "procedure")
STITCHED = "link string, entity string, src string, dst string, type string, confidence double"
MISSING = "link string, entity string, path string, what string"


def stitchable(nodes: DataFrame) -> DataFrame:
    """The columns and types of nodes that stitching reads."""
    types = (*ROUTES, *CONTRACTS, "react.api_client", "django.htmx", "openapi.path", "react.form_schema", "graphql.operation", "react.test", "react.route", "django.serializer_field", "graphql.field")
    return nodes.where(F.col("type").isin(*types)).select("id", "type", "name", "qualified_name", "file_path", "context", "extra")


def _of(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("type").isin(*types))


def _flag(key: str) -> Column:
    return F.coalesce(extra(key, "boolean"), F.lit(False))


def includes(nodes: DataFrame) -> DataFrame:
    """include, app, prefix, pos of URL includes."""
    rows = _of(nodes, "django.route").where(extra("include").isNotNull())
    target = F.element_at(F.filter(F.split(extra("include"), r"\."), lambda s: ~s.isin("", "urls", "urlpatterns")), -1)
    return rows.select(F.col("id").alias("include"), target.alias("app"), F.coalesce(extra("route"), F.col("name")).alias("prefix"), F.col("id").alias("pos"))


def _bare_routes(nodes: DataFrame) -> DataFrame:
    rows = _of(nodes, *ROUTES).where(extra("include").isNull())
    return rows.select(F.col("id").alias("route"), extra("app").alias("app"), F.coalesce(extra("raw"), extra("route"), F.col("name")).alias("path"))


def routes(nodes: DataFrame) -> DataFrame:
    """route, path under which it is published."""
    mounted = stitch.apply_includes(_bare_routes(nodes), includes(nodes).drop("include"))
    return mounted.select("route", F.coalesce("mounted_at", "path").alias("path"))


def clients(nodes: DataFrame, globs: DataFrame | None = None) -> DataFrame:
    """client, url, generated, path of API clients.

    ``globs``: pattern; files that match one hold generated clients, as do paths that say so.
    """
    rows = _of(nodes, "react.api_client").select("id", "name", "file_path", "extra")
    marked = F.coalesce(F.concat(F.lit("/"), "file_path", F.lit("/")).contains("/generated/") | F.lower(F.substring_index("file_path", "/", -1)).contains("openapi"), F.lit(False))
    generated = _flag("generated") | _flag("typed_client") | marked
    if globs is not None:
        # a glob is a row: its pattern is compiled by the engine, row by row
        files = rows.select("file_path").distinct()
        hit = files.join(F.broadcast(globs), F.call_function("rlike", "file_path", glob_pattern(F.col("pattern")))).select("file_path").distinct().withColumn("by_glob", F.lit(True))
        rows = rows.join(hit, "file_path", "left")
        generated = generated | F.coalesce("by_glob", F.lit(False))
    return rows.select(F.col("id").alias("client"), F.coalesce(extra("raw"), F.col("name")).alias("url"), generated.alias("generated"), F.col("file_path").alias("path"), extra("procedure").alias("procedure"))


def superseded(found: DataFrame) -> DataFrame:
    """``superseded`` for clients (client, url, generated): whether a generated client has the same template."""
    template = normalize_url(F.col("url"))
    better = found.where("generated").select(template.alias("template")).distinct().withColumn("better", F.lit(True))
    rows = found.withColumn("template", template).join(better, "template", "left")
    return rows.withColumn("superseded", ~F.col("generated") & F.coalesce("better", F.lit(False))).drop("better")


def field_sets(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """key, field of contracts (a subset of the nodes): fields they list, and those that are nodes of their own."""
    listed = parents.select(F.col("id").alias("key"), F.explode(extra("fields", "array<string>")).alias("field"))
    own = field_nodes(nodes).join(parents.select(F.col("id").alias("key"), F.col("qualified_name").alias("parent")), "parent").select("key", "field")
    return listed.unionByName(own).distinct()


def field_nodes(nodes: DataFrame) -> DataFrame:
    """node, parent, field of fields that are nodes."""
    return _of(nodes, "django.serializer_field", "graphql.field").select(F.col("id").alias("node"), F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("parent"), F.col("name").alias("field"))


def _operations(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Client operations (client, name, selections) and server ones (server, name) of GraphQL."""
    rows = _of(nodes, "graphql.operation")
    mine = rows.where(_flag("client")).select(F.col("id").alias("client"), "name", extra("selections", "array<string>").alias("selections"), F.col("file_path").alias("path"))
    return mine, rows.where(~_flag("client")).select(F.col("id").alias("server"), "name")


def _calls(nodes: DataFrame) -> DataFrame:
    """call, url of HTMX attributes; URLs that a template tag gives can't be matched."""
    rows = _of(nodes, "django.htmx").select(F.col("id").alias("call"), F.coalesce(extra("raw"), extra("url"), F.col("name")).alias("url"), F.col("file_path").alias("path"))
    return rows.where((F.col("url") != "") & ~F.col("url").startswith("{%"))


def _visits(nodes: DataFrame) -> DataFrame:
    return _of(nodes, "react.test").select(F.col("id").alias("client"), F.explode(extra("visits", "array<string>")).alias("url"))


def _pages(nodes: DataFrame) -> DataFrame:
    return _of(nodes, "react.route").select(F.col("id").alias("route"), F.col("name").alias("path"))


def _procedures(nodes: DataFrame) -> DataFrame:
    rows = _of(nodes, "react.api_client").where(extra("procedure").isNotNull())
    return rows.select(F.col("id").alias("call"), F.regexp_replace(extra("procedure"), r"\.", "/").alias("url"))


def _named(nodes: DataFrame) -> DataFrame:
    """route, path of what a procedure's name may end with."""
    rows = _of(nodes, "graphql.operation", "fastapi.route", "django.route").where(~_flag("client"))
    return rows.select(F.col("id").alias("route"), F.regexp_replace(F.coalesce(extra("raw"), extra("route"), F.col("name")), r"^[A-Z]+\s+", "").alias("path")).where("path <> ''")


def _published(nodes: DataFrame) -> DataFrame:
    """operation, path of described API operations."""
    return _of(nodes, "openapi.path").select(F.col("id").alias("operation"), F.regexp_replace("name", r"^[A-Z]+\s+", "").alias("path"))


def _template_keys(template: Column) -> Column:
    return let(template, lambda t: F.filter(F.array(match_key(t), mounted_key(t)), lambda k: k.isNotNull()))


def kinds_in(nodes: DataFrame) -> set[str]:
    """The types of some nodes, of which the vocabulary has a few dozen: links without entities or providers are left out of a plan."""
    return {r["type"] for r in nodes.select("type").distinct().collect()}


def _side(link: str, which: str, rows: DataFrame, id: str, keys: Column) -> DataFrame:
    return rows.select(F.lit(link).alias("link"), F.lit(which).alias("side"), F.col(id).alias("id"), F.explode(keys).alias("key"))


def derivation_keys(nodes: DataFrame) -> DataFrame:
    """The keys of derived entities and of what they are derived from."""
    rows = [
        _side("include", "e", _bare_routes(nodes), "route", F.array("app")), _side("include", "p", includes(nodes), "include", F.array("app")),
        _side("field", "e", _of(nodes, *CONTRACTS), "id", F.array("qualified_name")), _side("field", "p", field_nodes(nodes), "node", F.array("parent")),
    ]
    return reduce(DataFrame.unionByName, rows).where("key is not null").distinct()


def keys_of(nodes: DataFrame, globs: DataFrame | None = None) -> DataFrame:
    """link, side (e: entity, p: provider), id, key: what shares no key can't be linked."""
    url, path, there = F.col("url"), F.col("path"), kinds_in(nodes)
    rows = [derivation_keys(nodes)]
    if there & set(ROUTES):
        own_routes = routes(nodes)
        route_keys = own_routes.select(F.col("route").alias("id"), F.explode(_template_keys(route_template(path))).alias("key"))
        sides = F.array(*(F.struct(F.lit(link).alias("link"), F.lit(side).alias("side")) for link, side in (("client", "p"), ("htmx", "p"), ("visit", "p"), ("published", "e"))))
        rows.append(route_keys.select(F.explode(sides).alias("s"), "id", "key").select("s.link", "s.side", "id", "key"))
        rows.append(_side("htmx", "p", own_routes, "route", stitch.suffixes(path)))
    if "react.api_client" in there:
        own = clients(nodes, globs).select("client", normalize_url(url).alias("template"), "generated")
        kinds = F.array(*(F.struct(F.lit(link).alias("link"), F.lit(side).alias("side")) for link, side in (("superseded", "e"), ("superseded", "p"), ("operation", "e"))))
        each = own.select(F.explode(kinds).alias("s"), F.col("client").alias("id"), F.col("template").alias("key"), "generated").where("s.side = 'e' or generated")
        rows += [_side("client", "e", own, "client", _template_keys(F.col("template"))), each.select("s.link", "s.side", "id", "key"), _side("procedure", "e", _procedures(nodes), "call", stitch.suffixes(url))]
    if "openapi.path" in there:
        rows += [_side("operation", "p", _published(nodes), "operation", F.array(normalize_url(path))), _side("published", "p", _published(nodes), "operation", _template_keys(route_template(path)))]
    if "react.form_schema" in there:
        forms = _of(nodes, "react.form_schema")
        rows.append(_side("schema", "e", stitch.prefixes(forms.select(F.col("id").alias("key"), F.explode(extra("fields", "array<string>")).alias("field"))), "key", F.col("prefix")))
    if there & set(CONTRACTS):
        rows.append(_side("schema", "p", stitch.prefixes(field_sets(nodes, _of(nodes, *CONTRACTS))), "key", F.col("prefix")))
    if "graphql.operation" in there:
        mine, servers = _operations(nodes)
        names = F.concat(F.array("name"), F.coalesce("selections", F.array().cast("array<string>")))
        rows += [_side("graphql", "e", mine, "client", F.transform(names, F.lower)), _side("graphql", "p", servers, "server", F.array(F.lower("name")))]
    if "django.htmx" in there:
        rows.append(_side("htmx", "e", _calls(nodes), "call", F.array_union(_template_keys(normalize_url(url)), stitch.suffixes(url))))
    if "react.test" in there:
        rows.append(_side("visit", "e", _visits(nodes), "client", _template_keys(e2e_template(url))))
    if "react.route" in there:
        rows.append(_side("visit", "p", _pages(nodes), "route", _template_keys(route_template(path))))
    if there & {"graphql.operation", "fastapi.route", "django.route"}:
        rows.append(_side("procedure", "p", _named(nodes), "route", stitch.suffixes(path)))
    return reduce(DataFrame.unionByName, rows).where("key is not null").distinct()


def linked(nodes: DataFrame, globs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What all links give over these nodes: edges (as ``STITCHED``), and what stays open (as ``MISSING``)."""
    there, spark = kinds_in(nodes), nodes.sparkSession
    found, gaps = [spark.createDataFrame([], STITCHED)], [spark.createDataFrame([], MISSING)]

    def edges(link: str, rows: DataFrame, entity: str, src: str, dst: str, kind: str, confidence: Column) -> None:
        found.append(rows.select(F.lit(link).alias("link"), F.col(entity).alias("entity"), F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), confidence.cast("double").alias("confidence")))

    def open_(link: str, rows: DataFrame, entity: str, what: Column) -> None:
        gaps.append(rows.select(F.lit(link).alias("link"), F.col(entity).alias("entity"), "path", what.alias("what")))

    own_routes, published = routes(nodes), _published(nodes)
    if "react.api_client" in there:
        callers = superseded(clients(nodes, globs).where("procedure is null"))
        by_route = stitch.match_routes(callers, own_routes).join(callers, "client")
        edges("client", by_route, "client", "route", "client", "consumed_by_client", stitch.client_confidence(F.col("generated"), F.col("superseded")))
        matched = by_route.select("client")
        if "openapi.path" in there:
            by_operation = callers.join(published.select("operation", normalize_url(F.col("path")).alias("template")), "template")
            edges("operation", by_operation, "client", "operation", "client", "consumed_by_client", F.when(F.col("generated"), 1.0).when(F.col("superseded"), 0.45).otherwise(0.7))
            matched = matched.unionByName(by_operation.select("client"))
        lost = callers.where(F.col("template").startswith("/api/")).join(matched.distinct(), "client", "left_anti")
        open_("client", lost, "client", F.concat(F.lit("no route for "), "url"))
        inferred = by_route.where("not generated").select("client", "path", "template", "superseded").distinct()
        cover = F.when(F.col("superseded"), " (a generated client covers it)").otherwise(" (no generated client)")
        open_("client", inferred, "client", F.concat(F.lit("inferred from a plain URL: "), "template", cover))
        spoken_for = stitch.match_suffix(_procedures(nodes), _named(nodes))
        edges("procedure", spoken_for, "call", "route", "call", "consumed_by_client", F.lit(0.7))
        procedures = clients(nodes).where("procedure is not null")
        open_("procedure", procedures.join(spoken_for.select(F.col("call").alias("client")), "client", "left_anti"), "client", F.concat(F.lit("no route for procedure "), "procedure"))
    if "openapi.path" in there:
        spoken = stitch.match_routes(own_routes.select(F.col("route").alias("client"), F.col("path").alias("url")), published.select(F.col("operation").alias("route"), "path"))
        edges("published", spoken, "client", "client", "route", "publishes_route", F.lit(1.0))
    if "react.form_schema" in there:
        contracts, forms = _of(nodes, *CONTRACTS), _of(nodes, "react.form_schema")
        kinds = forms.select(F.col("id").alias("right"), F.coalesce((extra("kind") == "graphql-codegen") | _flag("generated"), F.lit(False)).alias("typed"), "name", F.col("file_path").alias("path"))
        fields, held = field_sets(nodes, contracts), forms.select(F.col("id").alias("key"), F.explode(extra("fields", "array<string>")).alias("field")).distinct()
        like = stitch.schema_similarity(fields, held).join(kinds, "right")
        ratio = F.col("overlap") / F.col("size")
        edges("schema", like, "right", "left", "right", "matches_schema", F.when(F.col("typed"), F.least(F.lit(0.95), 0.55 + ratio)).otherwise(F.least(F.lit(0.85), 0.4 + ratio)))
        open_("schema", like.where("not typed"), "right", F.concat(F.lit("inferred from shared fields: "), "left", F.lit(" and "), "name"))
        parents = contracts.select(F.col("id").alias("left"), F.col("qualified_name").alias("parent"))
        hits = like.join(parents, "left").join(field_nodes(nodes), "parent").join(held.withColumnRenamed("key", "right"), ["right", "field"])
        edges("schema", hits, "right", "node", "right", "matches_schema", F.when(F.col("typed"), 0.85).otherwise(0.6))
    if "graphql.operation" in there:
        mine, servers = _operations(nodes)
        asked = stitch.match_graphql(mine, servers)
        edges("graphql", asked, "client", "server", "client", "consumed_by_client", F.lit(0.92))
        open_("graphql", mine.join(asked.select("client"), "client", "left_anti"), "client", F.concat(F.lit("no server field for operation "), "name"))
    if "django.htmx" in there:
        calls = _calls(nodes)
        matches = stitch.match_routes(calls.withColumnRenamed("call", "client"), own_routes).select(F.col("client").alias("call"), "route")
        ended = stitch.suffix_pairs(calls, own_routes).unionByName(matches).distinct()
        edges("htmx", ended, "call", "route", "call", "consumed_by_client", F.lit(0.8))
        open_("htmx", calls.join(ended.select("call").distinct(), "call", "left_anti"), "call", F.concat(F.lit("no route for "), "url"))
    if "react.test" in there:
        visits = stitch.match_routes(_visits(nodes).select("client", e2e_template(F.col("url")).alias("url")), own_routes.unionByName(_pages(nodes)))
        edges("visit", visits, "client", "route", "client", "tested_by", F.lit(0.9))
    return reduce(DataFrame.unionByName, found).distinct(), reduce(DataFrame.unionByName, gaps).distinct()


def as_edges(rows: DataFrame) -> DataFrame:
    """Edges of stitched rows; of several links' rows the last one's counts, of one link's the surest."""
    order = F.array_position(F.array(*map(F.lit, LINKS)), F.col("link"))
    last = rows.groupBy("src", "dst", "type").agg(F.max(F.struct(order.alias("o"), "confidence")).alias("last"))
    return make_edges(last.select("src", "dst", "type", "last.confidence"))


def operation_nodes(operations: DataFrame) -> DataFrame:
    """Nodes of described API operations (path, method, operation)."""
    named = F.concat_ws(" ", "method", "path")
    return operations.select(node_id("openapi.path", named).alias("id"), F.lit("openapi.path").alias("type"), named.alias("name"), named.alias("qualified_name")).distinct()


def stitched(graph: Graph, globs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cross-language edges of a graph, and what stays open (path, what, line)."""
    found, gaps = linked(stitchable(graph.nodes), globs)
    return as_edges(found), gaps.select("path", "what", F.lit(None).cast("int").alias("line"))
