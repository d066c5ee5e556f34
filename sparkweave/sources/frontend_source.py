"""TypeScript and JavaScript source to graph rows, by patterns over whole files."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

METHODS = "get|post|put|patch|delete"
# What the patterns of the frontend libraries look like.
FUNCTION = re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_]\w*)|(?:export\s+)?const\s+([A-Za-z_]\w*)\s*(?::[^=\n]+)?=\s*(?:React\.)?(?:memo\(|forwardRef\()?\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)")
IMPORT = re.compile(r"import\s+(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\{([^}]*)\})?\s*(?:\*\s+as\s+(\w+))?\s*from\s*['\"]([^'\"]+)['\"]")
FETCH = re.compile(rf"\b(?:fetch|axios|api|client|http|request)(?:\.({METHODS}))?\s*(?:<[^>]*>)?\(\s*[`'\"]([^`'\"]+)[`'\"]", re.I)
TYPED = re.compile(rf"\b\w+\.({METHODS})\s*\(\s*['\"](/[^'\"]*)['\"]|\.(GET|POST|PUT|PATCH|DELETE)\(\s*['\"](/[^'\"]*)['\"]")
RTK = re.compile(r"(\w+)\s*:\s*\w+\.(query|mutation)\b")
RTK_URL = re.compile(r"url\s*:\s*[`'\"]([^`'\"]+)|query\s*:\s*\([^)]*\)\s*=>\s*[`'\"]([^`'\"]+)")
TRPC = re.compile(r"\btrpc\.([\w.]+)\.(useQuery|useMutation|query|mutate)\b")
ROUTE = re.compile(r"<Route[^>]*\bpath\s*=\s*['\"{`]+([^'\"`}]+)['\"}`]+[^>]*\belement\s*=\s*\{\s*<(\w+)|path\s*:\s*['\"]([^'\"]+)['\"]\s*,\s*(?:element\s*:\s*<(\w+)|Component\s*:\s*(\w+))")
QUERY_KEY = re.compile(r"queryKey\s*:\s*\[([^\]]*)\]")
INVALIDATE = re.compile(r"invalidateQueries\(\s*\{?\s*(?:queryKey\s*:)?\s*\[([^\]]*)\]")
ZOD = re.compile(r"const\s+(\w+)\s*=\s*z\.object\(\{(.*?)\}\)", re.S)
FIELD = re.compile(r"^\s*(\w+)\s*[?:]", re.M)
CONTEXT = re.compile(r"const\s+(\w+)\s*=\s*(?:React\.)?createContext\b")
JSX = re.compile(r"<([A-Z]\w*)")
HOOK_USE = re.compile(r"\b(use[A-Z]\w*)\s*\(")
REGISTER = re.compile(r"register\(\s*['\"](\w+)['\"]|<(?:input|Input|Field)[^>]*\bname\s*=\s*['\"](\w+)['\"]")
VISIT = re.compile(r"(?:page\.goto|cy\.visit|visit)\(\s*[`'\"]([^`'\"]+)[`'\"]")
TEST_NAME = re.compile(r"\b(?:it|test)\(\s*[`'\"]([^`'\"]+)")
DOCUMENT = re.compile(r"\b(query|mutation|subscription)\s+(\w+)[^{]*\{([^}]*)")
GENERATED_TYPE = re.compile(r"export type (\w+) = \{(.*?)\};", re.S)
GROUPS = re.compile(r"^\(.*\)$|^@")


def feature_of(path: str) -> str:
    parts = path.split("/")
    if "features" in parts[:-2]:
        return parts[parts.index("features") + 1]
    if "app" in parts[:-1]:
        rest = [p for p in parts[parts.index("app") + 1 : -1] if not GROUPS.match(p) and not p.startswith("[")]
        return rest[0] if rest else "app"
    return "app"


def file_route(path: str) -> tuple[str, str] | None:
    """URL and kind (page, layout, route) of a file in an app or pages directory."""
    parts = path.split("/")
    stem = parts[-1].split(".")[0]
    urls = lambda ps: "/" + "/".join("{id}" if re.fullmatch(r"\[.*\]", p) else p for p in ps)
    if "app" in parts[:-1] and stem in ("page", "layout", "route"):
        return urls([p for p in parts[parts.index("app") + 1 : -1] if not GROUPS.match(p)]), stem
    if "pages" in parts[:-1] and not stem.startswith("_"):
        inner = parts[parts.index("pages") + 1 : -1] + ([] if stem == "index" else [stem])
        return urls(inner), "route" if inner[:1] == ["api"] else "page"
    return None


class Rows:
    def __init__(self, path: str, source: str):
        self.path, self.feature, self.rows, self.clients = path, feature_of(path), [], {}
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def node(self, node_type: str, qualified: str, name: str, at: int | None = None, **extra) -> str:
        extra = {k: v for k, v in ({"feature": self.feature} | extra).items() if v is not None}
        self.rows.append(("node", f"{node_type}:{qualified}", node_type, name, qualified, None if at is None else self.line(at), None, None, None, json.dumps(extra, sort_keys=True)))
        return f"{node_type}:{qualified}"

    def edge(self, src: str, kind: str, dst: str, confidence: float = 1.0, **extra) -> None:
        self.rows.append(("edge", f"{src}|{kind}|{dst}", kind, None, None, None, src, dst, confidence, json.dumps(extra, sort_keys=True) if extra else None))

    def client(self, url: str, at: int, owner: str, **extra) -> None:
        """One node a URL and file; a typed client takes the place of a plain one."""
        typed = bool(extra.get("typed_client"))
        if not self.clients.get(url, False):
            self.node("react.api_client", f"client:{self.path}:{url}", url, at, raw=url, **extra)
            self.clients[url] = typed
        self.edge(owner, "calls", f"react.api_client:client:{self.path}:{url}")


def kind_of(name: str, path: str) -> str | None:
    if re.match(r"use[A-Z]", name):
        return "react.hook"
    if not name[:1].isupper():
        return None
    return "react.page" if name.endswith("Page") or "/pages/" in f"/{path}" else "react.component"


def extract(path: str, source: str) -> Iterator[tuple]:
    out = Rows(path, source)
    f = out.feature
    is_test = bool(re.search(r"\.(test|spec|cy|e2e)\.|__tests__/|(^|/)(e2e|cypress|playwright)/", path))
    feature = out.node("react.feature", f"features.{f}", f)
    spans = [(m.start(), m[1] or m[2]) for m in FUNCTION.finditer(source)]
    shown = [(at, name, kind_of(name, path)) for at, name in spans]
    ids = {}
    for at, name, kind in shown:
        if kind and not is_test:
            body = source[at : next((a for a, _ in spans if a > at), len(source))]
            fields = sorted({a or b for a, b in REGISTER.findall(body)})
            extra = {"form_fields": fields or None, "mutation": "useMutation" in body or None, "invalidation": "invalidateQueries" in body or None, "has_error_boundary": "ErrorBoundary" in body or None}
            ids[name] = out.node(kind, f"{f}.{name}", name, at, **extra)
            out.edge(ids[name], "belongs_to", feature)

    def owner(at: int) -> str:
        inside = [name for a, name in spans if a <= at and name in ids]
        return ids[inside[-1]] if inside else feature

    imported = {}
    for m in IMPORT.finditer(source):
        target = feature_of(m[4].lstrip("./")) if "features/" in m[4] else f
        for name in filter(None, [m[1], m[3], *(n.split(" as ")[-1].strip() for n in (m[2] or "").split(","))]):
            imported[name] = target
            if kind_of(name, m[4]):
                out.edge(feature, "imports", f"{kind_of(name, m[4])}:{target}.{name}")
    if is_test:
        tests(out, path, source, imported)
        return iter(out.rows)
    for m in JSX.finditer(source):
        if m[1] in ids or m[1] in imported:
            for kind in ("react.component", "react.page"):
                out.edge(owner(m.start()), "renders", f"{kind}:{imported.get(m[1], f)}.{m[1]}", 0.9)
    for m in HOOK_USE.finditer(source):
        if m[1] in ids or m[1] in imported:
            out.edge(owner(m.start()), "calls", f"react.hook:{imported.get(m[1], f)}.{m[1]}")
    generated = "/generated/" in f"/{path}" or "openapi" in path.rsplit("/", 1)[-1].lower()
    for m in FETCH.finditer(source):
        out.client(m[2], m.start(), owner(m.start()), method=(m[1] or "get").upper(), generated=generated or None)
    for m in TYPED.finditer(source):
        if "openapi-fetch" in source or "ts-rest" in source:
            out.client(m[2] or m[4], m.start(), owner(m.start()), method=(m[1] or m[3]).upper(), typed_client=True)
    ends = [m.start() for m in RTK.finditer(source)] + [len(source)]
    for m, end in zip(RTK.finditer(source), ends[1:]):
        if "createApi" in source and (u := RTK_URL.search(source[m.start() : min(end, m.start() + 500)])):
            name = m[1][:1].upper() + m[1][1:]
            hook = out.node("react.hook", f"{f}.use{name}{m[2].title()}", f"use{name}{m[2].title()}", m.start())
            out.client(u[1] or u[2], m.start(), hook, typed_client=True)
    for m in TRPC.finditer(source):
        client = out.node("react.api_client", f"client:{path}:trpc.{m[1]}", f"trpc.{m[1]}", m.start(), procedure=m[1], typed_client=True)
        out.edge(owner(m.start()), "calls", client)
    for m in ROUTE.finditer(source):
        url, page = m[1] or m[3], m[2] or m[4] or m[5]
        route = out.node("react.route", f"react.route:{url}", url, m.start())
        for kind in ("react.page", "react.component"):
            out.edge(route, "publishes_route", f"{kind}:{imported.get(page, f)}.{page}", 0.9)
    for pattern, edge in ((QUERY_KEY, "uses_query_key"), (INVALIDATE, "invalidates_cache")):
        for m in pattern.finditer(source):
            key = re.sub(r"[\s'\"]", "", m[1])
            out.edge(owner(m.start()), edge, out.node("react.query_key", f"{f}.queryKey.{key}", key, m.start()))
    for m in ZOD.finditer(source):
        out.node("react.form_schema", f"{f}.{m[1]}", m[1], m.start(), fields=FIELD.findall(m[2]), kind="zod")
    for m in CONTEXT.finditer(source):
        out.node("react.context", f"{f}.{m[1]}", m[1], m.start())
    if re.search(r"^\s*['\"]use server['\"]", source, re.M):
        for at, name in spans:
            out.node("react.server_action", f"{f}.{name}", name, at)
    for m in DOCUMENT.finditer(source):
        picked = re.findall(r"^\s*(\w+)", m[3], re.M)[:8]
        operation = out.node("graphql.operation", f"client.{m[2]}", m[2], m.start(), client=True, selections=picked)
        out.edge(owner(m.start()), "calls", operation)
    if "graphql" in path and ("generated" in path or "generated" in source[:2500]):
        for m in GENERATED_TYPE.finditer(source):
            fields = [x for x in FIELD.findall(m[2]) if x != "__typename"]
            out.node("react.form_schema", f"{f}.{m[1]}", m[1], m.start(), fields=fields, kind="graphql-codegen", generated=True)
    if found := file_route(path):
        url, kind = found
        if kind != "layout":
            route = out.node("react.route", f"react.route:{url}", url)
            for name, node in ids.items():
                if kind == "page" and node.partition(":")[0] in ("react.page", "react.component"):
                    out.edge(route, "publishes_route", node)
    return iter(out.rows)


def tests(out: Rows, path: str, source: str, imported: dict[str, str]) -> None:
    visits = VISIT.findall(source)
    test = out.node("react.test", f"test.{path}", path.rsplit("/", 1)[-1], 0, names=TEST_NAME.findall(source), visits=visits or None, e2e=bool(visits) or None)
    for name, feature in imported.items():
        if kind := kind_of(name, path):
            out.edge(f"{kind}:{feature}.{name}", "tested_by", test)
