"""Layouts told by paths."""

import json

from pyspark.sql import functions as F

from sparkweave.functions import paths
from sparkweave.operators import layout
from sparkweave.sources import tree


def of(spark, *files):
    return spark.createDataFrame([f if isinstance(f, tuple) else (f, None) for f in files], "path string, content string")


def test_apps_have_one_root(spark):
    files = of(spark, "code/srv/shop/apps.py", "code/srv/shop/models.py", "code/srv/core/users/apps.py", "code/srv/tests/fake/apps.py", "manage.py", "node_modules/x/apps.py", "ui/src/features/shop/a.tsx", "ui/src/features/auth/b/c.tsx", "ui/src/features/readme.md")
    got = {tuple(r) for r in layout.layout(files).collect()}
    assert got == {("root", "backend", "code/srv"), ("root", "frontend", "ui/src"), ("app", "shop", "code/srv/shop"), ("app", "users", "code/srv/core/users"), ("feature", "shop", "ui/src/features/shop"), ("feature", "auth", "ui/src/features/auth")}
    draft = {c["name"]: c for c in tree.draft_manifest(files).contexts}
    assert draft["identity"] == {"name": "identity", "apps": ["users"], "ui": ["ui/src/features/auth"], "owners": ["identity-team"]} and draft["shop"]["ui"] == ["ui/src/features/shop"]


def test_roots_without_apps(spark):
    asks = json.dumps({"devDependencies": {"react-dom": "18"}})
    files = of(spark, "a/b/manage.py", "a/tests/manage.py", "x/manage.py", ("pkg/web/package.json", asks), ("pkg/web/src/a.ts", None), ("p/package.json", asks), ("demo/package.json", asks), ("q/package.json", "{}"))
    got = {tuple(r) for r in layout.layout(files).collect()}
    assert got == {("root", "backend", "x"), ("root", "frontend", "pkg/web/src")}
    nothing = {tuple(r) for r in layout.layout(of(spark, "readme.md")).collect()}
    assert nothing == {("root", "backend", "backend"), ("root", "frontend", "frontend/src")}
    assert tree.draft_manifest(of(spark, "readme.md")).contexts[0]["name"] == "app"
    assert ("root", "backend", "api") in {tuple(r) for r in layout.layout(of(spark, "api/x.py", "app/y.py")).collect()}


def test_globs_of_generated_files(spark):
    cases = [("**/gen/*.ts", "a/b/gen/x/y.ts", True), ("**/gen/*.ts", "a/gen.ts", False), ("src/*.{ts,js}", "src/a/b.js", True), ("src/*.{ts,js}", "src/a.py", False), ("a?c[xy].ts", "abcx.ts", True), ("a?c[!xy].ts", "abcx.ts", False), ("a.b+c(d)", "a.b+c(d)", True), ("a.b", "axb", False), ("a\\\\**", "a/b/c", True)]
    rows = spark.createDataFrame([(g.replace("\\\\", "\\"), p, w) for g, p, w in cases], "glob string, path string, want boolean")
    assert rows.where(F.call_function("rlike", "path", paths.glob_pattern(F.col("glob"))) != F.col("want")).collect() == []
