"""URL templates as column functions: parameters become ``{id}``, and templates match by a canonical key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading segments under which an API may be mounted.
API_MOUNTS = ("api", "v1", "v2", "v3", "backend")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that it names more than once: the value is computed once, and the expression stays small."""
    return F.transform(F.array(value), then)[0]


def normalize_url(url: Column) -> Column:
    """Client URL to template: ``${x}``, ``:x`` and ``<x>`` to ``{id}``, no origin, single slashes."""
    u = F.trim(url)
    for pattern in (r"\$\{[^}]+\}", r":[A-Za-z_][A-Za-z0-9_]*", r"<[^>]+>"):
        u = F.regexp_replace(u, pattern, "{id}")
    rooted = let(u, lambda u: F.when(u.startswith("/"), u).when(u.startswith("http"), F.regexp_replace(u, r"https?://[^/]+", "")).otherwise(F.concat(F.lit("/"), u)))
    return let(F.regexp_replace(F.regexp_replace(rooted, "/+", "/"), "/+$", ""), lambda slim: F.when(slim == "", "/").otherwise(slim))


def strip_anchors(route: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(route, r"^\^", ""), r"\$$", "")


def named_groups(route: Column) -> Column:
    """Named groups ``(?P<slug>...)`` to ``{slug}``, whatever groups, classes and escapes they hold.

    A fold over the characters: outside of groups they are kept; inside, brackets are counted, but for escaped
    ones and those of a class. A group that never ends stays as it is.
    """
    def step(s: Column, c: Column) -> Column:
        plain = s["last"] != "\\"
        opens, closes = ~s["inside"] & plain & (c == "("), ~s["inside"] & plain & (c == ")")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        inside = F.when(plain & (c == "["), True).when(plain & (c == "]"), False).otherwise(s["inside"])
        held = F.concat(s["held"], c)
        name = F.regexp_extract(held, r"^\(\?P<([^>]*)>", 1)
        starts, ends = (s["depth"] == 0) & (c == "("), (s["depth"] > 0) & (depth == 0)
        whole = F.when(held.rlike(r"^\(\?P<[^>]*>"), F.concat(F.lit("{"), name, F.lit("}"))).otherwise(held)

        def state(out, held, depth, inside):
            return F.struct(out.alias("out"), held.alias("held"), depth.cast("int").alias("depth"), inside.alias("inside"), c.alias("last"))

        return F.when(starts, state(s["out"], c, F.lit(1), F.lit(False))).when(ends, state(F.concat(s["out"], whole), F.lit(""), F.lit(0), F.lit(False))).when(
            s["depth"] > 0, state(s["out"], held, depth, inside)).otherwise(state(F.concat(s["out"], c), F.lit(""), F.lit(0), F.lit(False)))

    start = F.struct(F.lit("").alias("out"), F.lit("").alias("held"), F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit("").alias("last"))
    folded = F.aggregate(F.filter(F.split(route, ""), lambda c: c != ""), start, step, lambda s: F.concat(s["out"], s["held"]))
    return F.when(route.contains("(?P<"), folded).otherwise(route)


def route_template(route: Column) -> Column:
    """Server route to template: converters ``<int:pk>`` and named groups to ``{id}``, one leading slash."""
    r = named_groups(strip_anchors(F.trim(route)))
    r = F.regexp_replace(F.regexp_replace(r, r"<[^>]+>", "{id}"), r"\{[^}]+\}", "{id}")
    return let(F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), r), "/+", "/"), "/+$", ""), lambda slim: F.when(slim == "", "/").otherwise(slim))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def match_key(path: Column) -> Column:
    """Equal for templates that match segment by segment, parameters being wild."""
    return F.array_join(F.transform(segments(path), lambda s: F.when(s.rlike(r"^(\{.*\}|:.*|<.*>)$"), "{}").otherwise(s)), "/")


def mounted_key(path: Column) -> Column:
    """``match_key`` without a leading API mount; null if there is none."""
    def bare(key: Column) -> Column:
        head = F.substring_index(key, "/", 1)
        return F.when(F.lower(head).isin(*API_MOUNTS), F.when(F.instr(key, "/") > 0, F.substring(key, F.length(head) + 2, 1 << 30)).otherwise(F.lit("")))

    return let(match_key(path), bare)


def paths_match(a: Column, b: Column) -> Column:
    """Equal but for parameters, or but for one API mount in front of either."""
    a, b = normalize_url(a), route_template(b)
    return (match_key(a) == match_key(b)) | F.coalesce(mounted_key(a) == match_key(b), F.lit(False)) | F.coalesce(match_key(a) == mounted_key(b), F.lit(False))


def e2e_template(url: Column) -> Column:
    """Visited URL to template: numeric segments become ``{id}``."""
    return normalize_url(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/\d+(?=/|$)", "/{id}"))


def dynamic_segment(segment: Column) -> Column:
    """File segment to URL segment: ``[id]``, ``[...slug]`` become ``{id}``."""
    return F.when(segment.rlike(r"^\[.*\]$"), "{id}").otherwise(segment)


def join_route(prefix: Column, route: Column) -> Column:
    p, r = F.trim(strip_anchors(prefix), F.lit("/")), F.trim(strip_anchors(route), F.lit("/"))
    return route_template(F.concat_ws("/", F.when(p != "", p), F.when(r != "", r)))


def join_base(base: Column, path: Column) -> Column:
    return normalize_url(F.when(base.isNull() | (base == ""), path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))))


def published_route(mounted_at: Column, full_path: Column, declared: Column) -> Column:
    return F.coalesce(F.nullif(mounted_at, F.lit("")), F.nullif(full_path, F.lit("")), declared)


def public_api(spec: Column) -> tuple[Column, Column]:
    """Method (any if none) and template of ``METHOD path``."""
    spec = F.trim(spec)
    has = spec.rlike(r"^[A-Za-z]+\s+/")
    return F.when(has, F.upper(F.substring_index(spec, " ", 1))).otherwise("ANY"), route_template(F.when(has, F.regexp_replace(spec, r"^[A-Za-z]+\s+", "")).otherwise(spec))


def _without_id(path: Column) -> Column:
    return F.regexp_replace(path, r"/\{id\}$", "")


def path_belongs(url: Column, allowed: Column) -> Column:
    """Same template, same but for a trailing parameter, or below it."""
    return F.array_contains(belonging_keys(url), allowed_key(allowed))


def allowed_key(allowed: Column) -> Column:
    """Key of a published path: its template without a trailing parameter."""
    return _without_id(route_template(allowed))


def belonging_keys(url: Column) -> Column:
    """The keys of all published paths to which a URL belongs: its template without a trailing parameter, and all paths above it."""
    def above(u: Column) -> Column:
        parts = F.split(u, "/")
        cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        return F.array_distinct(F.concat(F.filter(cuts, lambda c: c != u), F.array(_without_id(u))))

    return let(normalize_url(url), above)
