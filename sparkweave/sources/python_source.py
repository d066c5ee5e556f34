"""Python source to graph rows: one pass over the syntax tree, a detector a construct.

``extract`` turns one file into rows (kind, id, type, name, qualified_name, line, src, dst, confidence,
extra): kind is node, edge or residual. Edges may lead to ids that no file defines; pruning drops them.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

from sparkweave.functions.paths import PACKAGE_DIRS

# Names of base classes, calls and fields by what they stand for.
RELATIONS = {"ForeignKey", "OneToOneField", "ManyToManyField", "GenericForeignKey", "GenericRelation"}
ACTIONS = ("list", "create", "retrieve", "update", "partial_update", "destroy")
LOOKUPS = {"filter": "filter", "exclude": "filter", "get": "filter", "order_by": "order"}
ENQUEUES = {"delay": "celery", "apply_async": "celery", "send": "dramatiq", "send_with_options": "dramatiq", "enqueue": "rq"}
DESTRUCTIVE = {"RemoveField", "DeleteModel", "AlterField", "RenameField", "RenameModel"}
METHODS = ("get", "post", "put", "patch", "delete", "api_operation")
SIGNALS = {"post_save", "pre_save", "post_delete", "pre_delete", "m2m_changed"}


def app_of(path: str) -> str:
    """The last directory that isn't a package's."""
    parts = [p for p in path.split("/")[:-1] if p and p not in PACKAGE_DIRS]
    return parts[-1] if parts else "root"


def dotted(node: ast.AST | None) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value)}.{node.attr}".lstrip(".")
    if isinstance(node, ast.Call):
        return dotted(node.func)
    return ""


def last(node: ast.AST | None) -> str:
    return dotted(node).rsplit(".", 1)[-1]


def text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def texts(node: ast.AST | None) -> list[str]:
    """Strings of a literal list, tuple or set."""
    return [x.value for x in node.elts if text(x) is not None] if isinstance(node, (ast.List, ast.Tuple, ast.Set)) else []


def names(node: ast.AST | None) -> list[str]:
    """Last parts of the names in a list, or of a single name."""
    return [n for n in map(last, node.elts) if n] if isinstance(node, (ast.List, ast.Tuple)) else [last(node)] if last(node) else []


def keyword(call: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def assigned(body: list[ast.stmt]) -> dict[str, ast.AST]:
    """Name to value of plain and annotated assignments."""
    out = {}
    for s in body:
        if isinstance(s, ast.Assign):
            out |= {t.id: s.value for t in s.targets if isinstance(t, ast.Name)}
        elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
            out[s.target.id] = s.value or s.annotation
    return out


def complexity(function: ast.AST) -> int:
    """One more than the branches, functions inside left out."""
    total, todo = 1, list(ast.iter_child_nodes(function))
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            continue
        if isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)):
            total += 1
        elif isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
        todo += ast.iter_child_nodes(node)
    return total


class Rows:
    """What one file gives."""

    def __init__(self, path: str):
        self.path, self.app, self.rows = path, app_of(path), []

    def node(self, kind: str, qualified: str, name: str, line: int | None = None, **extra) -> str:
        found = f"{kind}:{qualified}"
        extra = {k: v for k, v in ({"app": self.app} | extra).items() if v is not None}
        self.rows.append(("node", found, kind, name, qualified, line, None, None, None, json.dumps(extra, sort_keys=True)))
        return found

    def edge(self, src: str, kind: str, dst: str, confidence: float = 1.0, **extra) -> None:
        self.rows.append(("edge", f"{src}|{kind}|{dst}", kind, None, None, None, src, dst, confidence, json.dumps(extra, sort_keys=True) if extra else None))

    def residual(self, what: str, line: int | None = None) -> None:
        self.rows.append(("residual", None, None, what, None, line, None, None, None, None))


def extract(path: str, source: str) -> Iterator[tuple]:
    out = Rows(path)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        out.residual(f"{path} can't be parsed: {type(e).__name__}", getattr(e, "lineno", None))
        return iter(out.rows)
    if "/migrations/" in f"/{path}":
        migrations(out, tree)
    else:
        Detector(out, tree).run()
    return iter(out.rows)


class Detector:
    def __init__(self, out: Rows, tree: ast.Module):
        self.out, self.tree, self.app = out, tree, out.app
        self.stem = out.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        self.imports = dict(self._imports())

    def _imports(self) -> Iterator[tuple[str, str]]:
        for node in ast.walk(self.tree):
            if isinstance(node, ast.ImportFrom):
                for a in node.names:
                    yield a.asname or a.name, f"{node.module or ''}.{a.name}".lstrip(".")
            elif isinstance(node, ast.Import):
                for a in node.names:
                    yield (a.asname or a.name).split(".")[0], a.name

    def home(self, name: str) -> str:
        """app.Name of a class or function: by its import, else of this file's app."""
        path = self.imports.get(name.split(".")[0])
        parts = [p for p in (path or "").split(".")[:-1] if p and p not in PACKAGE_DIRS]
        return f"{parts[-1] if parts else self.app}.{name.rsplit('.', 1)[-1]}"

    def run(self) -> None:
        for node in self.tree.body:
            if isinstance(node, ast.ClassDef):
                self.class_(node)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(node)
        for node in ast.walk(self.tree):
            if isinstance(node, ast.Call):
                self.call(node)
            elif isinstance(node, ast.Dict):
                self.schedule(node)

    def schedule(self, node: ast.Dict) -> None:
        """An entry of a schedule: a task by name, and when it runs."""
        entry = {text(k): v for k, v in zip(node.keys, node.values) if k is not None and text(k)}
        if "schedule" in entry and text(entry.get("task")):
            parts = [p for p in text(entry["task"]).split(".") if p not in PACKAGE_DIRS][-2:]
            task = ".".join(parts if len(parts) == 2 else [self.app, *parts])
            self.out.node("django.task", task, parts[-1], node.lineno, referenced=True, scheduled=True)
            self.out.residual(f"task {task} is scheduled by name", node.lineno)

    # classes: the first fitting kind counts

    def class_(self, node: ast.ClassDef) -> None:
        bases = {last(b) for b in node.bases}
        full = {self.imports.get(dotted(b).split(".")[0], dotted(b)) + "." + last(b) for b in node.bases}
        qualified, body = f"{self.app}.{node.name}", assigned(node.body)
        ends = lambda *s: any(b.endswith(s) for b in bases)
        if ends("TestCase", "TestSuite") or node.name.startswith("Test"):
            return self.tests(node)
        if "Schema" in bases and any("ninja" in f for f in full) or "BaseModel" in bases:
            parent = self.out.node("fastapi.model", qualified, node.name, node.lineno, fields=list(body))
            return self._fields(parent, "django.serializer_field", qualified, list(body), node.lineno)
        if ends("Serializer"):
            return self.serializer(node, body, "django.serializer")
        if ends("ModelForm", "Form") or ends("FilterSet"):
            return self.serializer(node, body, "django.form")
        if ends("Permission", "BasePermission"):
            name = qualified if node.name.endswith("Permission") else node.name
            self.out.node("django.permission", name, node.name, node.lineno)
        elif ends("Consumer"):
            self.out.node("django.consumer", qualified, node.name, node.lineno)
        elif "BaseCommand" in bases:
            self.out.node("django.management_command", f"{self.app}.{self.stem}", self.stem, node.lineno)
        elif ends("ModelAdmin"):
            self.out.node("django.admin", qualified, node.name, node.lineno)
        elif ends("AppConfig"):
            if any(isinstance(s, ast.FunctionDef) and s.name == "ready" for s in node.body):
                self.out.residual(f"{node.name}.ready() runs code at start", node.lineno)
        elif ends("View", "ViewSet", "APIView", "Mixin") and not ends("PermissionMixin") or ends("GenericViewSet"):
            self.view(node, body)
        elif any("graphene" in f or "strawberry" in f for f in full) or {"strawberry.type", "type"} & {dotted(d) for d in node.decorator_list}:
            self.graphql(node, body)
        elif ends("Model", "AbstractUser") or any(f.startswith("django.db.models") for f in full):
            self.model(node, body)
        elif ends("Task", "Actor"):
            run = next((f for f in node.body if isinstance(f, ast.FunctionDef) and f.name in ("run", "perform")), None)
            self.task(node.name, node.lineno, run.args if run else None, "celery" if ends("Task") else "dramatiq")
        elif node.name.endswith(("Service", "UseCase", "Manager", "Repository")) or self.stem in ("services", "selectors"):
            self.queries(self.out.node("django.service", qualified, node.name, node.lineno), node)

    def _fields(self, parent: str, kind: str, qualified: str, fields: list[str], line: int) -> None:
        for f in fields:
            self.out.edge(parent, "has_field", self.out.node(kind, f"{qualified}.{f}", f, line))

    def model(self, node: ast.ClassDef, body: dict[str, ast.AST]) -> None:
        qualified = f"{self.app}.{node.name}"
        parent = self.out.node("django.model", qualified, node.name, node.lineno)
        self.out.edge(parent, "belongs_to", f"django.app:{self.app}")
        self.out.node("django.app", self.app, self.app)
        for name, value in body.items():
            kind = last(value) if isinstance(value, ast.Call) else ""
            if not (kind.endswith("Field") or kind in RELATIONS):
                continue
            flags = {k: True for k in ("db_index", "unique", "null", "blank") if isinstance(keyword(value, k), ast.Constant) and keyword(value, k).value is True}
            for k in ("max_length", "max_digits", "decimal_places"):
                if isinstance(keyword(value, k), ast.Constant):
                    flags[k] = keyword(value, k).value
            deleted = last(keyword(value, "on_delete")) or None
            field = self.out.node("django.field", f"{qualified}.{name}", name, value.lineno, field_type=kind, relation=kind in RELATIONS or None, on_delete=deleted, **flags)
            self.out.edge(parent, "has_field", field)
            if kind in RELATIONS and value.args:
                target = text(value.args[0])
                target = qualified if target == "self" else target if target and "." in target else f"{self.app}.{target}" if target else self.home(dotted(value.args[0]))
                self.out.edge(field, "relates_to", f"django.model:{target}", **({"on_delete": deleted} if deleted else {}))

    def serializer(self, node: ast.ClassDef, body: dict[str, ast.AST], kind: str) -> None:
        qualified = f"{self.app}.{node.name}"
        meta = next((assigned(c.body) for c in node.body if isinstance(c, ast.ClassDef) and c.name == "Meta"), {})
        fields = list(dict.fromkeys([*texts(meta.get("fields")), *(n for n, v in body.items() if isinstance(v, ast.Call))]))
        for f in node.body:
            if isinstance(f, ast.FunctionDef) and f.name == "to_representation":
                for r in ast.walk(f):
                    if isinstance(r, ast.Return) and isinstance(r.value, ast.Dict):
                        fields += [k.value for k in r.value.keys if text(k) and k.value not in fields]
        reads = any(isinstance(f, ast.FunctionDef) and mentions_queryset(f) for f in node.body)
        parent = self.out.node(kind, qualified, node.name, node.lineno, fields=fields, queryset_in_serializer=reads or None)
        self._fields(parent, "django.serializer_field", qualified, fields, node.lineno)
        if last(meta.get("model")):
            self.out.edge(parent, "serializes", f"django.model:{self.home(dotted(meta['model']))}")
        for name, value in body.items():
            if isinstance(value, ast.Call) and last(value).endswith("Serializer"):
                self.out.edge(f"django.serializer_field:{qualified}.{name}", "uses_serializer", f"django.serializer:{self.home(dotted(value))}")

    def view(self, node: ast.ClassDef, body: dict[str, ast.AST]) -> None:
        qualified = f"{self.app}.{node.name}"
        view = self.out.node("django.view", qualified, node.name, node.lineno)
        for key, edge, kind in (("permission_classes", "has_permission", "django.permission"), ("throttle_classes", "has_permission", "django.throttle")):
            for name in names(body.get(key)):
                target = self.home(name) if name.endswith("Permission") else name
                self.out.edge(view, edge, self.out.node(kind, target, name, None, referenced=True))
        used = [last(body.get("serializer_class"))] + [last(r.value) for f in node.body if isinstance(f, ast.FunctionDef) and f.name == "get_serializer_class" for r in ast.walk(f) if isinstance(r, ast.Return)]
        for name in dict.fromkeys(filter(None, used)):
            self.out.edge(view, "uses_serializer", f"django.serializer:{self.home(name)}")
        if text(body.get("template_name")):
            self.out.edge(view, "serves_template", f"django.template:{text(body['template_name'])}")
        for f in node.body:
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and (f.name in ACTIONS or any(last(d) == "action" for d in f.decorator_list)):
                self.out.edge(view, "calls", self.out.node("django.viewset_action", f"{qualified}.{f.name}", f.name, f.lineno))
        self.queries(view, node)

    def queries(self, owner: str, node: ast.AST) -> None:
        """Models that a node queries, loops over querysets, and lookups."""
        for a in ast.walk(node):
            if isinstance(a, ast.Attribute) and a.attr == "objects" and dotted(a.value)[:1].isalpha():
                self.out.edge(owner, "queries_model", f"django.model:{self.home(dotted(a.value))}", 0.8)
        loops, found = list(nplusone(node)), list(lookups(node))
        if loops or found:
            kind, _, qualified = owner.partition(":")
            self.out.node(kind, qualified, qualified.rsplit(".", 1)[-1], node.lineno, **({"nplusone": loops} if loops else {}), **({"lookups": found} if found else {}))

    def graphql(self, node: ast.ClassDef, body: dict[str, ast.AST]) -> None:
        qualified = f"{self.app}.{node.name}"
        if node.name in ("Query", "Mutation", "Subscription"):
            for f in node.body:
                if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and not f.name.startswith("_"):
                    self.out.node("graphql.operation", f"server.{f.name.removeprefix('resolve_')}", f.name.removeprefix("resolve_"), f.lineno)
            return
        parent = self.out.node("graphql.type", qualified, node.name, node.lineno, fields=list(body))
        self._fields(parent, "graphql.field", qualified, list(body), node.lineno)

    def tests(self, node: ast.AST) -> None:
        functions = [f for f in ast.walk(node) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and f.name.startswith("test")]
        for f in functions:
            seen = sorted({n.id for n in ast.walk(f) if isinstance(n, ast.Name)} | {n.attr for n in ast.walk(f) if isinstance(n, ast.Attribute)} | {n.value for n in ast.walk(f) if text(n) and n.value.isidentifier()})
            test = self.out.node("django.test", f"{self.app}.{f.name}", f.name, f.lineno, mentions=seen)
            for name in seen:
                if name[:1].isupper():  # what it is, other files say
                    for kind in ("django.view", "django.model", "django.serializer", "django.service", "django.form", "django.consumer", "django.admin"):
                        self.out.edge(f"{kind}:{self.home(name)}", "tested_by", test, 0.7)
                elif self.imports.get(name, "").rsplit(".", 2)[-2:-1] == ["tasks"]:
                    self.out.edge(f"django.task:{self.home(name)}", "tested_by", test, 0.7)

    # functions: all fitting kinds count

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        decorators, qualified = {last(d): d for d in node.decorator_list}, f"{self.app}.{node.name}"
        if decorators.keys() & {"shared_task", "task", "actor", "job"}:
            self.task(node.name, node.lineno, node.args, "dramatiq" if "actor" in decorators else "rq" if "job" in decorators else "celery")
        if "receiver" in decorators:
            d = decorators["receiver"]
            receiver = self.out.node("django.receiver", qualified, node.name, node.lineno)
            for name in names(d.args[0] if isinstance(d, ast.Call) and d.args else None):
                self.out.edge(self.out.node("django.signal", name, name), "receives", receiver)
            sender = keyword(d, "sender") if isinstance(d, ast.Call) else None
            if sender is not None and dotted(sender):
                self.out.edge(f"django.model:{self.home(dotted(sender))}", "emits_signal", receiver)
        elif self.stem in ("signals", "handlers", "receivers") and node.args.args and node.args.args[0].arg == "sender":
            self.out.node("django.receiver", qualified, node.name, node.lineno, inferred=True)
        if decorators.keys() & {"api_view", "login_required", "require_http_methods", "csrf_exempt", "permission_required"} or self.stem == "views" and node.args.args[:1] and node.args.args[0].arg == "request":
            view = self.out.node("django.view", qualified, node.name, node.lineno)
            self.queries(view, node)
        elif self.stem in ("services", "selectors") and not node.name.startswith("_"):
            self.queries(self.out.node("django.service", qualified, node.name, node.lineno), node)
        if node.name.startswith("test"):
            self.tests(ast.Module([node], []))
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and last(d) in METHODS and d.args and text(d.args[0]) is not None:
                self.operation(node, d)

    def operation(self, node: ast.FunctionDef, d: ast.Call) -> None:
        method, path = last(d).upper(), text(d.args[0])
        route = self.out.node("fastapi.route", f"{self.app}:{method} {path}", f"{method} {path}", node.lineno, raw=path)
        shown = [*names(keyword(d, "response_model")), *names(keyword(d, "response")), *names(node.returns)]
        for name in dict.fromkeys(n for n in shown if n[:1].isupper()):
            self.out.edge(route, "uses_serializer", f"fastapi.model:{self.home(name)}")

    def task(self, name: str, line: int, args: ast.arguments | None, broker: str) -> None:
        arguments = [a.arg for a in args.args if a.arg != "self"] if args else []
        keyed = any(a in ("pk", "id", "uuid") or a.endswith(("_id", "_pk", "_uuid")) for a in arguments)
        self.out.node("django.task", f"{self.app}.{name}", name, line, args=arguments, broker=broker, looks_idempotent_on_pk=keyed, referenced=False)

    # calls anywhere in the file

    def owner(self, call: ast.Call) -> str:
        for node in self.tree.body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.lineno <= call.lineno <= (node.end_lineno or node.lineno):
                kind = "django.service" if self.stem in ("services", "selectors") else "django.task" if self.stem == "tasks" else "django.receiver" if self.stem in ("signals", "handlers", "receivers") else "django.view"
                return f"{kind}:{self.app}.{node.name}"
        return f"django.view:{self.app}.{self.stem}"

    def call(self, node: ast.Call) -> None:
        name, method = dotted(node.func), last(node.func)
        first = text(node.args[0]) if node.args else None
        if method in ENQUEUES and isinstance(node.func, ast.Attribute) and dotted(node.func.value) and dotted(node.func.value) not in ("self", "mail"):
            task = self.home(dotted(node.func.value))
            target = self.out.node("django.task", task, task.split(".")[-1], None, broker=ENQUEUES[method], referenced=True)
            self.out.edge(self.owner(node), "enqueues", target, 0.9)
        elif method in ("chain", "group", "chord") and node.args:
            links = [a for arg in node.args for a in (arg.elts if isinstance(arg, (ast.List, ast.Tuple)) else [arg])]
            for link in links:
                if isinstance(link, ast.Call) and last(link.func) in ("s", "si", "signature") and isinstance(link.func, ast.Attribute) and dotted(link.func.value):
                    task = self.home(dotted(link.func.value))
                    self.out.edge(self.owner(node), "enqueues", self.out.node("django.task", task, task.split(".")[-1], None, broker="celery", referenced=True), 0.9)
        elif method == "send_task" and first:
            parts = [p for p in first.split(".") if p not in PACKAGE_DIRS]
            self.out.edge(self.owner(node), "enqueues", f"django.task:{'.'.join(parts[-2:])}", 0.7)
            self.out.residual(f"task {first} is sent by name", node.lineno)
        elif method in ("path", "re_path", "url") and first is not None and len(node.args) > 1 and method == name:
            self.url(node, first)
        elif method == "register" and "router" in name and len(node.args) > 1 and first is not None:
            route = self.out.node("django.route", f"{self.app}:{first}", first, node.lineno, route=first, router=True)
            self.out.edge(route, "publishes_route", f"django.view:{self.home(dotted(node.args[1]))}")
        elif name.startswith("cache.") and first:
            key = self.out.node("django.cache_key", f"cache:{first}", first, node.lineno)
            self.out.edge(self.owner(node), "invalidates_cache" if method in ("set", "delete", "delete_many", "clear", "incr") else "calls", key)
        elif method in ("flag_is_active", "switch_is_active", "is_enabled", "feature_enabled"):
            flag = next(filter(None, map(text, node.args)), None)
            if flag:
                self.out.edge(self.owner(node), "checks_flag", self.out.node("django.feature_flag", f"flag:{flag}", flag, node.lineno))
        elif method == "on_commit":
            owner = self.owner(node)
            effect = self.out.node("django.side_effect", f"{owner.partition(':')[2]}:on_commit:{node.lineno}", "on_commit", node.lineno)
            self.out.edge(owner, "on_commit", effect)
        elif method == "connect" and name.split(".")[0] in SIGNALS and node.args:
            handler = self.home(dotted(node.args[0]))
            self.out.edge(self.out.node("django.signal", name.split(".")[0], name.split(".")[0]), "receives", f"django.receiver:{handler}")
            self.out.residual(f"{handler} is connected at run time", node.lineno)
        elif method == "send" and name.split(".")[0] in self.imports and "signals" in self.imports[name.split(".")[0]]:
            self.out.edge(self.owner(node), "emits_signal", f"django.signal:{name.split('.')[0]}")
        elif method == "get_model" and first:
            self.out.residual(f"model {first} is looked up by name", node.lineno)
        elif method in ("reverse", "reverse_lazy") and first:
            self.out.edge(self.owner(node), "calls", f"django.url_name:{first}", 0.7)
        elif method in ("raw", "execute") and isinstance(node.func, ast.Attribute) and first:
            self.out.residual("raw SQL", node.lineno)
        elif method == "render" and len(node.args) > 1 and text(node.args[1]):
            self.out.edge(self.owner(node), "serves_template", f"django.template:{text(node.args[1])}")

    def url(self, node: ast.Call, route: str) -> None:
        target, label = node.args[1], text(keyword(node, "name"))
        include = text(target.args[0]) if isinstance(target, ast.Call) and last(target) == "include" and target.args else None
        socket = self.stem in ("routing", "asgi") or isinstance(target, ast.Call) and last(target) == "as_asgi"
        identity = route or include or label or f"{self.out.path}:{node.lineno}"
        found = self.out.node("django.websocket_route" if socket else "django.route", f"{self.app}:{identity}", route, node.lineno, route=route, include=include, url_name=label)
        if label:
            self.out.edge(self.out.node("django.url_name", label, label, node.lineno), "calls", found)
        handler = dotted(target.func.value) if isinstance(target, ast.Call) and isinstance(target.func, ast.Attribute) else dotted(target)
        if handler and not include:
            self.out.edge(found, "publishes_route", f"{'django.consumer' if socket else 'django.view'}:{self.home(handler.rsplit('.', 1)[-1] if '.' in handler else handler)}")


def mentions_queryset(node: ast.AST) -> bool:
    return any(isinstance(a, ast.Attribute) and a.attr in ("objects", "filter", "exclude", "select_related", "prefetch_related") for a in ast.walk(node))


def queryset_shape(node: ast.AST, bound: dict[str, ast.AST]) -> tuple[bool, set[str]]:
    """Whether an expression is a queryset, and which relations it has fetched (``*``: all)."""
    fetched: set[str] = set()
    is_query = False
    while True:
        if isinstance(node, ast.Name) and node.id in bound:
            node, bound = bound[node.id], {k: v for k, v in bound.items() if k != node.id}
        elif isinstance(node, ast.Call):
            method = last(node.func)
            if method in ("select_related", "prefetch_related"):
                given = [text(a) for a in node.args]
                if node.args and isinstance(node.args[0], ast.Constant) and node.args[0].value is None:
                    fetched.clear()
                fetched |= {g.split("__")[0] for g in given if g} or {"*"}
            node = node.func
        elif isinstance(node, ast.Attribute):
            is_query |= node.attr in ("objects", "get_queryset")
            node = node.value
        else:
            return is_query, fetched


def nplusone(node: ast.AST) -> Iterator[dict]:
    """Loops over a queryset whose body follows attributes of the loop's variable that weren't fetched."""
    bound = {t.id: s.value for s in ast.walk(node) if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name)}
    for loop in ast.walk(node):
        if not (isinstance(loop, (ast.For, ast.AsyncFor)) and isinstance(loop.target, ast.Name)):
            continue
        is_query, fetched = queryset_shape(loop.iter, bound)
        if not is_query or "*" in fetched:
            continue
        touched = []
        for a in (x for s in loop.body for x in ast.walk(s)):
            # x.rel.name, or x.rels.all()
            if isinstance(a, ast.Attribute) and isinstance(a.value, ast.Attribute) and isinstance(a.value.value, ast.Name) and a.value.value.id == loop.target.id and a.value.attr not in fetched:
                touched.append((a.value.attr, a.attr in ("all", "filter", "count", "exists", "first")))
        if touched:
            many = any(m for _, m in touched)
            seen = list(dict.fromkeys(t for t, _ in touched))
            yield {"line": loop.lineno, "loop_var": loop.target.id, "accessed": seen, "suggested_fix": f".{'prefetch' if many else 'select'}_related({', '.join(map(repr, seen))})"}


def lookups(node: ast.AST) -> Iterator[dict]:
    """Fields by which querysets are searched or ordered, keys left out."""
    for call in ast.walk(node):
        if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr in LOOKUPS and queryset_shape(call.func.value, {})[0]:
            used = [k.arg for k in call.keywords if k.arg] if call.func.attr != "order_by" else [a.lstrip("-") for a in map(text, call.args) if a]
            fields = [f for f in dict.fromkeys(u.split("__")[0] for u in used) if f not in ("pk", "id")]
            if fields:
                yield {"kind": LOOKUPS[call.func.attr], "fields": fields, "line": call.lineno}


def migrations(out: Rows, tree: ast.Module) -> None:
    stem = out.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for call in ast.walk(tree):
        if not (isinstance(call, ast.Call) and dotted(call.func).startswith("migrations.")):
            continue
        kind = last(call.func)
        given = [a for a in map(text, call.args) if a] + [f"{k.arg}={text(k.value)}" for k in call.keywords if text(k.value)]
        model = text(keyword(call, "model_name")) or (text(keyword(call, "name")) if kind.endswith("Model") else None)
        field = text(keyword(call, "name")) if kind.endswith("Field") else None
        op = out.node("django.migration_op", f"{out.app}.{stem}.{kind}({','.join(given)})", kind, call.lineno, op=kind, args=[a for a in map(text, call.args) if a], model_name=model, field_name=field)
        if kind in DESTRUCTIVE:
            out.edge(op, "destructive_migration", op)
            if model and field:
                out.edge(op, "destructive_migration", f"django.field:{out.app}.{model}.{field}")


def functions(path: str, source: str) -> Iterator[tuple[str, str, int, int, int]]:
    """path, name, first and last line, complexity of every function."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield path, node.name, node.lineno, node.end_lineno or node.lineno, complexity(node)
