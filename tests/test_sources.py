"""Parsers, trees and whole reviews on a small tree of our own."""

import json
import subprocess
import time

import pytest

from sparkweave.plans import review as R
from sparkweave.operators import history
from sparkweave.sources import extraction, frontend_source, python_source, store, tree
from sparkweave.streaming import incremental

TREE = {
    "back/shop/models.py": "from django.db import models\n\nclass Order(models.Model):\n    buyer = models.ForeignKey('people.Person', on_delete=models.CASCADE)\n    total = models.IntegerField(db_index=True)\n    state = models.CharField(max_length=9)\n",
    "back/people/models.py": "from django.db import models\n\nclass Person(models.Model):\n    name = models.CharField(max_length=9)\n",
    "back/shop/serializers.py": "from shop.models import Order\n\nclass OrderSerializer(ModelSerializer):\n    label = SerializerMethodField()\n    class Meta:\n        model = Order\n        fields = ['total', 'state']\n",
    "back/shop/views.py": "from shop.models import Order\nfrom shop.serializers import OrderSerializer\nfrom shop.tasks import mail_buyer\nfrom people.models import Person\n\nclass OrderView(APIView):\n    serializer_class = OrderSerializer\n    permission_classes = [IsAuthenticated]\n    def list(self, request):\n        for o in Order.objects.filter(state='x'):\n            print(o.buyer.name)\n        Person.objects.get(name='y')\n        mail_buyer.delay('a@b')\n",
    "back/shop/tasks.py": "@shared_task\ndef mail_buyer(address):\n    pass\n",
    "back/shop/urls.py": "from shop.views import OrderView\nurlpatterns = [path('orders/<int:pk>/', OrderView.as_view(), name='order')]\n",
    "back/site/urls.py": "urlpatterns = [path('api/', include('shop.urls'))]\n",
    "back/shop/tests.py": "from shop.serializers import OrderSerializer\n\ndef test_order():\n    assert OrderSerializer\n",
    "back/shop/migrations/0002_drop.py": "class Migration(migrations.Migration):\n    operations = [migrations.RemoveField(model_name='order', name='state')]\n",
    "back/shop/broken.py": "def x(:\n",
    "back/shop/templates/shop/list.html": "{% extends 'base.html' %}{% url 'order' %}<a hx-get=\"/api/orders/1\">",
    "front/src/features/orders/OrderPage.tsx": "import { useOrder } from './useOrder'\nexport function OrderPage() {\n  const order = useOrder()\n  return <div/>\n}\n",
    "front/src/features/orders/useOrder.ts": "export const useOrder = () => useQuery({ queryKey: ['order'], queryFn: () => fetch(`/api/orders/${id}`) })\n",
    "front/src/features/orders/schema.ts": "export const orderSchema = z.object({\n  total: z.number(),\n  state: z.string(),\n  note: z.string(),\n})\n",
    "front/e2e/order.spec.ts": "test('shows', async () => { await page.goto('/orders/7') })\n",
    "front/src/App.tsx": "import { OrderPage } from './features/orders/OrderPage'\nexport const App = () => <Route path=\"/orders/:id\" element={<OrderPage/>}/>\n",
    "front/node_modules/x/index.js": "fetch('/never')\n",
}
MANIFEST = tree.Manifest([
    {"name": "shop", "apps": ["shop"], "owners": ["shop-team"], "ui": ["front/src/features/orders"], "public_api": ["GET /api/other"]},
    {"name": "people", "apps": ["people"], "owners": ["people-team"], "public_api": ["GET /api/orders"]},
])


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(TREE.items()), "path string, content string")


@pytest.fixture(scope="module")
def index(files):
    return R.index_tree(files, MANIFEST)


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


def test_index(index):
    nodes, edges = ids(index.graph.nodes), ids(index.graph.edges)
    assert {"django.model:shop.Order", "django.field:shop.Order.buyer", "django.serializer_field:shop.OrderSerializer.label", "django.view:shop.OrderView", "django.task:shop.mail_buyer", "django.template:shop/list.html", "react.page:orders.OrderPage", "react.hook:orders.useOrder", "react.form_schema:orders.orderSchema", "react.route:react.route:/orders/:id"} <= nodes
    assert not any("never" in n for n in nodes)
    route = "django.route:shop:orders/<int:pk>/"
    client = "react.api_client:client:front/src/features/orders/useOrder.ts:/api/orders/${id}"
    assert {
        f"{route}|publishes_route|django.view:shop.OrderView", f"{route}|consumed_by_client|{client}", "django.view:shop.OrderView|uses_serializer|django.serializer:shop.OrderSerializer",
        "django.field:shop.Order.buyer|relates_to|django.model:people.Person", "django.view:shop.OrderView|enqueues|django.task:shop.mail_buyer", "django.serializer:shop.OrderSerializer|tested_by|django.test:shop.test_order",
        "django.serializer:shop.OrderSerializer|matches_schema|react.form_schema:orders.orderSchema", "django.view:shop.OrderView|queries_model|django.model:people.Person", "react.page:orders.OrderPage|calls|react.hook:orders.useOrder",
    } <= edges
    ends = {x for r in index.graph.edges.collect() for x in (r["src"], r["dst"])}
    assert ends <= nodes
    task = index.graph.node("django.task:shop.mail_buyer").first()
    assert task["file_path"] == "back/shop/tasks.py" and json.loads(task["extra"])["args"] == ["address"]
    assert any("broken.py" in (r["path"] or "") for r in index.residuals.collect())


def test_review(spark, index):
    diff = spark.createDataFrame([("back/shop/serializers.py", "+x")], "path string, patch string")
    r = R.review(spark, index, diff, MANIFEST)
    reached = ids(r.impact.nodes)
    assert {"django.route:shop:orders/<int:pk>/", "react.form_schema:orders.orderSchema", "react.page:orders.OrderPage", "django.task:shop.mail_buyer"} <= reached
    found = {f["rule"] for f in r.document["findings"]}
    # UI files have a context by their directory, and call what another one publishes
    assert index.graph.node("react.hook:orders.useOrder").first()["context"] == "shop" and "react_feature_may_only_call_own_or_shared_api" in found
    assert {"views_cannot_import_other_context_models", "serializers_are_the_only_published_contract", "celery_tasks_must_be_idempotent_on_model_pk", "queryset_nplusone"} <= found
    assert r.document["confidence"]["level"] == "low" and R.gate(r.document) == 2 and "public_contract" in r.document["kinds"]
    assert r.document["reviewers"][0] in ("people-team", "shop-team") and r.document["read_order"] == ["back/shop/serializers.py"]
    assert R.html(r.document).count("<h2>") >= 3 and "passed=false" in R.gate_lines(r.document)
    lines = r.document["headline"].splitlines()
    assert lines[0].startswith("LOW: ") and [x.split(":")[0] for x in lines[1:]] == ["Sinks", "Contract", "Auth", "Tests", "Architecture", "Open", "Reviewers"]
    assert r.document["architecture_note"].split(":")[0] in found and r.document["sinks"] and r.document["headline"] in R.markdown(r.document)
    assert R.markdown(r.document).startswith("# Confidence low") and r.document["checklist"][0]["status"] == "todo"
    docs = R.review(spark, index, spark.createDataFrame([("README.md", "+x")], "path string, patch string"), MANIFEST)
    assert docs.document["headline"].splitlines()[1:4] == ["Sinks: none", "Contract: none", "Auth: no view on the path"]
    assert docs.document["findings"] == [] and docs.document["confidence"]["level"] == "high"


def test_architecture_and_drift(spark, index, files, tmp_path, monkeypatch):
    kept = store.Store(spark, str(tmp_path / "kept"))
    assert R.index_card(kept) == {"indexed": False, "counts": {"nodes": 0, "edges": 0}, "contexts": {}}
    report = R.architecture_report(index, MANIFEST, kept)
    found = sorted(map(repr, report["findings"].collect()))
    assert {r["rule"] for r in report["findings"].collect()} >= {"cascade_crosses_context", "migration_blast_radius", "queryset_missing_index"}
    # the second time no rule runs; a manifest with other rules is another version
    evaluate = R.rules.evaluate
    monkeypatch.setattr(R.rules, "evaluate", None)
    assert sorted(map(repr, R.architecture_report(index, MANIFEST, kept)["findings"].collect())) == found
    summary = R.index_summary(index, MANIFEST, kept)
    assert summary["counts"]["nodes"] == index.graph.nodes.count() and summary["findings"]["cascade_crosses_context"] >= 1 and summary["contexts"]["shop"]["apps"] == ["shop"]
    assert R.index_card(kept)["counts"] == summary["counts"] and R.index_card(kept)["version"] == R.findings_version(index, MANIFEST)
    fewer = tree.Manifest(MANIFEST.contexts, rules=["cascade_crosses_context"])
    with pytest.raises(TypeError):
        R.architecture_report(index, fewer, kept)
    monkeypatch.setattr(R.rules, "evaluate", evaluate)
    assert {r["rule"] for r in R.architecture_report(index, fewer, kept)["findings"].collect()} == {"cascade_crosses_context"}
    assert kept.forget("findings", R.findings_version(index, fewer)) == [R.findings_version(index, MANIFEST)]
    assert R.reindex(index, extraction.source_files(files), MANIFEST) is index


def test_only_changed_files_are_read_again(spark, index, files, monkeypatch):
    from pyspark.sql import functions as F

    read, extract = [], extraction.extract

    def counted(rows):
        read.extend(r["path"] for r in rows.select("path").collect())
        return extract(rows)

    paths = sorted(r["path"] for r in extraction.source_files(files).collect() if r["path"].endswith(".py"))
    edited = files.where(F.col("path") != paths[0]).withColumn("content", F.when(F.col("path") == paths[1], F.concat("content", F.lit("\n# more\n"))).otherwise(F.col("content")))
    edited = edited.unionByName(spark.createDataFrame([("src/late/services.py", "def late_service():\n    return 1\n")], "path string, content string").select(*edited.columns))
    monkeypatch.setattr(extraction, "extract", counted)
    again = R.reindex(index, edited, MANIFEST)
    assert sorted(read) == sorted([paths[1], "src/late/services.py"])
    whole = R.index_tree(edited, MANIFEST, index.operations)
    for got, want in ((again.graph.nodes, whole.graph.nodes), (again.graph.edges, whole.graph.edges), (again.residuals, whole.residuals)):
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_of_an_edge_the_last_version_counts(spark):
    from sparkweave.sources.extraction import RAW

    node = ("a.py", "node", "t:x", "t", "x", "x", 1, None, None, None, None, 0)
    edges = [("a.py", "edge", "t:x|calls|t:x", "calls", None, None, None, "t:x", "t:x", c, None, at) for at, c in ((1, 0.9), (2, 0.4))]
    g, _ = extraction.to_graph(spark.createDataFrame([node, *edges], RAW))
    assert [r["confidence"] for r in g.edges.collect()] == [0.4]


def test_python_details():
    rows = list(python_source.extract("a/urls.py", "urlpatterns = [path('', include('x.urls')), re_path('^s/$', V.as_view(), name='n')]\nrouter.register('r', W)\n"))
    assert {r[1] for r in rows if r[0] == "node"} == {"django.route:a:x.urls", "django.route:a:^s/$", "django.url_name:n", "django.route:a:r"}
    got = list(python_source.functions("m.py", "def f(a):\n    if a and b or c:\n        return [x for x in a if x]\n    def g():\n        while 1: pass\n"))
    assert [(g[1], g[4]) for g in got] == [("f", 5), ("g", 2)]
    rows = list(python_source.extract("a/views.py", "class V(APIView):\n    def get(self):\n        qs = M.objects.select_related('r')\n        for x in qs:\n            x.r.n; x.many.all()\n"))
    extra = next(json.loads(r[9]) for r in rows if r[9] and "nplusone" in r[9])
    rows = list(python_source.extract("a/views.py", "from b.tasks import one, two\ndef v(request):\n    chain(one.s(1), two.si()).apply_async()\nS = {'x': {'task': 'c.tasks.nightly', 'schedule': 5}}\n"))
    assert {r[7] for r in rows if r[2] == "enqueues"} >= {"django.task:b.one", "django.task:b.two"} and "django.task:c.nightly" in {r[1] for r in rows}
    assert extra["nplusone"][0]["accessed"] == ["many"]
    assert [r[3] for r in python_source.extract("a/b.py", "class A(:")] == ["a/b.py can't be parsed: SyntaxError"]


def test_frontend_details():
    assert frontend_source.file_route("web/app/(shop)/orders/[id]/page.tsx") == ("/orders/{id}", "page")
    assert frontend_source.file_route("web/pages/api/x.ts") == ("/api/x", "route") and frontend_source.file_route("web/src/x.ts") is None
    rows = list(frontend_source.extract("w/a.ts", "'use server'\nexport async function save() {}\nconst t = trpc.order.byId.useQuery()\nconst q = gql`query GetIt { it { id } }`\n"))
    assert {"react.server_action:app.save", "react.api_client:client:w/a.ts:trpc.order.byId", "graphql.operation:client.GetIt"} <= {r[1] for r in rows}


def test_owners_openapi_and_manifest(spark):
    assert tree.parse_codeowners("# c\n* @all # x\n\n/a/ @b @c\nalone\n") == [("*", ["@all"]), ("/a/", ["@b", "@c"])]
    doc = json.dumps({"paths": {"/a/{pk}": {"get": {"operationId": "one"}, "parameters": {}}, "/b": {"post": {}}}})
    got = {tuple(r) for r in tree.openapi_operations(spark, spark.createDataFrame([(doc,)], "content string")).collect()}
    assert got == {("/a/{id}", "GET", "one"), ("/b", "POST", None)}
    block = "openapi: 3.0.3\ninfo:\n  title: x\npaths:\n  /orders/{pk}/:\n    get:\n      operationId: orders_read\n      responses:\n        '200':\n          get: no\n    # a comment\n    parameters:\n    - name: pk\n    DELETE:\n      description: ''\n  '/quoted':\n      post:\n          operationId: \"make\"\ncomponents:\n  get:\n    operationId: never\n"
    documents = spark.createDataFrame([(block,), (block.replace("\n", "\r\n"),), ("",), ("just text",)], "content string")
    assert {tuple(r) for r in tree.openapi_operations(spark, documents).collect()} == {("/orders/{id}", "GET", "orders_read"), ("/orders/{id}", "DELETE", None), ("/quoted", "POST", "make")}
    m = tree.Manifest.parse(MANIFEST.write())
    other = tree.Manifest.parse(json.dumps({"contexts": [], "generated_clients": ["**/gen/*.ts"], "theme": {"dark": 1}}))
    assert other.generated_clients == ["**/gen/*.ts"] and json.loads(other.write())["theme"] == {"dark": 1} and ids(other.globs(spark), "pattern") == {"**/gen/*.ts"}
    assert m.rules is None and m.waive("leaked_seam", None, "x") and not m.waive("leaked_seam", None, "y")


def test_tree_and_git(spark, tmp_path):
    root = str(tmp_path / "r")
    for path, text in {"a/x.py": "x = 1\n", "node_modules/y.js": "y\n", ".hid/z.py": "z\n"}.items():
        f = tmp_path / "r" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    assert ids(tree.read_tree(spark, root), "path") == {"a/x.py"}
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a")
    git("commit", "-qm", "one")
    (tmp_path / "r/a/x.py").write_text("x = 2\ny = 3\n")
    git("commit", "-qam", "two")
    assert tree.git_log(spark, root).count() == 2
    d = tree.git_diff(spark, root, "HEAD~1", "HEAD").collect()
    assert [(r["path"], r["status"], r["added"], r["deleted"]) for r in d] == [("a/x.py", "M", 2, 1)] and "+y = 3" in d[0]["patch"]
    (tmp_path / "r/a/x.py").write_text("x = 4\n")
    (tmp_path / "r/new.py").write_text("n = 1\n")
    w = {r["path"]: (r["status"], r["added"]) for r in tree.git_worktree_diff(spark, root).collect()}
    assert w == {"a/x.py": ("M", 1), "new.py": ("A", 1), "node_modules/y.js": ("A", 1), ".hid/z.py": ("A", 1)}
    assert tree.find_manifest(f"{root}/a") is None and tree.write_draft(root, MANIFEST) and not tree.write_draft(root, MANIFEST)
    assert tree.find_manifest(f"{root}/a") == f"{root}/sparkweave.json"
    assert ids(tree.git_dirty(spark, root), "path") >= {"a/x.py"} and tree.git_refs(spark, root).count() == 1
    assert len(tree.resolve_range(root, "HEAD~1")) == 2


def test_stream_keeps_the_newest_version(spark, tmp_path):
    inbox, raw = tmp_path / "in", str(tmp_path / "raw")
    inbox.mkdir()

    def arrive(name, *rows):
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(("path", "content", "version"), r))) for r in rows))
        incremental.watch(spark, str(inbox), raw, str(tmp_path / "state")).awaitTermination(120)

    model = "from django.db import models\nclass {}(models.Model):\n    pass\n"
    arrive("1.json", ("a/m.py", model.format("Old"), 1), ("b/m.py", model.format("Keep"), 1))
    arrive("2.json", ("a/m.py", model.format("New"), 2))
    got = {r["id"] for r in incremental.current_rows(spark, raw).where("type = 'django.model'").collect()}
    assert got == {"django.model:a.New", "django.model:b.Keep"}


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    assert s.get_meta("a") is None and s.get_review("r") is None
    s.set_meta("a", "1")
    s.set_meta("a", "2")
    s.save_review("r", "2024-01-01", {"confidence": {"level": "low", "sinks": 3}, "findings": [{"waived": True}, {"waived": False}]}, base_ref="main")
    s.save_review("r", "2024-02-02", {"confidence": {"level": "high", "sinks": 4}, "findings": [{}]}, base_ref="other")
    assert s.get_meta("a") == "2"
    r = s.get_review("r")
    assert (r["created_at"], r["base_ref"], r["payload"]["confidence"]["level"]) == ("2024-01-01", "main", "high")
    shown = history.summarize_reviews(s.reviews()).first()
    assert (shown["level"], shown["sinks"], shown["findings"], shown["what_if"]) == ("high", 4, 1, False)
    assert history.list_reviews(s.reviews()).columns[:1] == ["id"] and "payload" not in history.list_reviews(s.reviews()).columns
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    assert store.fingerprint(files) == store.fingerprint(files.orderBy("path", ascending=False)) != store.fingerprint(files.where("path = 'a'"))


def test_files_are_parsed_once(spark):
    files = spark.createDataFrame([("src/a/models.py", "class A(models.Model):\n    x = models.IntegerField()\n")], "path string, content string")
    g, _ = extraction.to_graph(extraction.extract(files))
    for df in (g.nodes, g.edges):
        assert "MapInArrow" not in df._jdf.queryExecution().toString()  # read back, not parsed by each branch
    assert {r.id for r in g.nodes.collect()} >= {"django.model:a.A", "django.field:a.A.x"}
    assert {r.type for r in g.edges.collect()} == {"belongs_to", "has_field"}


def test_one_split_of_files_is_parsed_by_many_tasks(spark):
    files = spark.range(0, 200, 1, 1).selectExpr("concat('src/a/f', id, '.py') as path", "'def f():\\n    pass\\n' as content")
    assert files.rdd.getNumPartitions() == 1
    for df in (extraction.extract_sources(files), extraction.functions_table(files)):
        assert df.rdd.getNumPartitions() > 1
    assert extraction.functions_table(files).count() == 200


def test_descriptions_with_very_many_operations(spark):
    # a fold that copied what it had found so far took hundreds of times as long for a text ten times as long
    n = 40_000
    text = "openapi: 3.0.3\npaths:\n" + "".join(f"  /p{i}/:\n    get:\n      operationId: read_{i}\n    post:\n      responses: {{}}\n" for i in range(n)) + "info:\n  get:\n    operationId: none\n"
    began = time.time()
    rows = tree.openapi_operations(spark, spark.createDataFrame([(text,), (text,), ("paths:\n    /b/:\n      put:\n        operationId: late\n  /a/:\n    delete:\n",)], "content string"))
    got = {tuple(r) for r in rows.collect()}
    want = {(f"/p{i}", m, f"read_{i}" if m == "GET" else None) for i in range(n) for m in ("GET", "POST")}
    assert got == want | {("/b", "PUT", "late"), ("/a", "DELETE", None)} and time.time() - began < 60
