"""The graph's vocabulary and tables.

nodes: id, type, name, qualified_name, file_path, start_line, end_line, context, extra
edges: id, src, dst, type, weight, confidence, extra

``extra`` is JSON text at rest; operators read the keys they need into typed columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "id string, type string, name string, qualified_name string, file_path string, start_line int, end_line int, context string, extra string"
EDGES = "id string, src string, dst string, type string, weight string, confidence double, extra string"
FILES = "path string, hash string, language string"
REVIEWS = "id string, created_at string, repo_root string, base_ref string, head_ref string, payload string"
FINDINGS = "rule string, severity string, message string, node_id string, file_path string, waived boolean, extra string"

# Names of node types, edge types and their classes.
NODE_TYPES = (
    "arch.context", "django.app", "django.route", "django.url_name", "django.view", "django.viewset_action",
    "django.serializer", "django.serializer_field", "django.form", "django.service", "django.model", "django.field",
    "django.relation", "django.signal", "django.receiver", "django.task", "django.permission", "django.throttle",
    "django.migration_op", "django.admin", "django.management_command", "django.test", "django.consumer",
    "django.websocket_route", "django.template", "django.htmx", "django.cache_key", "django.feature_flag",
    "django.side_effect", "graphql.type", "graphql.field", "graphql.operation", "fastapi.route", "fastapi.model",
    "react.route", "react.page", "react.feature", "react.component", "react.hook", "react.api_client",
    "react.query_key", "react.form_schema", "react.context", "react.test", "react.server_action", "openapi.path",
)
CRITICAL_EDGES = ("publishes_route", "consumed_by_client", "crosses_context", "changes_permission", "destructive_migration")
EXPENSIVE_EDGES = (
    "serializes", "queries_model", "enqueues", "emits_signal", "receives", "uses_serializer", "has_permission",
    "tested_by", "matches_schema", "htmx_calls", "invalidates_cache", "on_commit", "publishes_graphql",
)
CHEAP_EDGES = ("calls", "imports", "renders", "belongs_to", "has_field", "serves", "uses_query_key", "relates_to", "serves_template", "checks_flag")
EDGE_TYPES = CHEAP_EDGES + EXPENSIVE_EDGES + CRITICAL_EDGES
#: Where a change becomes visible.
SINK_TYPES = (
    "django.route", "react.route", "react.page", "django.task", "django.migration_op", "django.permission",
    "django.throttle", "django.admin", "django.management_command", "openapi.path", "django.consumer",
    "django.websocket_route", "django.template", "django.cache_key", "django.feature_flag", "django.side_effect",
    "graphql.operation", "fastapi.route", "react.server_action",
)
CONTRACT_TYPES = (
    "django.serializer", "django.serializer_field", "django.form", "openapi.path", "react.form_schema", "django.route",
    "graphql.type", "graphql.field", "graphql.operation", "fastapi.model", "fastapi.route",
)
#: Shared by unrelated contexts: kept when reached, never expanded.
HUB_TYPES = ("django.permission", "django.throttle", "django.app", "arch.context", "django.url_name")
FORWARD_EDGES = tuple(t for t in EDGE_TYPES if t != "imports")
_NOT_BACKWARD = ("imports", "renders", "serves", "relates_to", "has_permission", "changes_permission", "crosses_context")
BACKWARD_EDGES = tuple(t for t in EDGE_TYPES if t not in _NOT_BACKWARD)
INFERRED_BELOW = 0.8


def node_id(node_type: Column | str, qualified_name: Column) -> Column:
    return F.concat_ws(":", F.lit(node_type) if isinstance(node_type, str) else node_type, qualified_name)


def edge_id(src: Column, edge_type: Column, dst: Column) -> Column:
    return F.concat_ws("|", src, edge_type, dst)


def weight_for(edge_type: Column) -> Column:
    return F.when(edge_type.isin(*CRITICAL_EDGES), "critical").when(edge_type.isin(*EXPENSIVE_EDGES), "expensive").otherwise("cheap")


def family_for(node_type: Column) -> Column:
    """Family of a type: what stands before its dot."""
    return F.substring_index(node_type, ".", 1)
