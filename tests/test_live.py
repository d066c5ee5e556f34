"""An index that follows edits equals a whole index of the same files, and reads only the partitions of what changed."""

import json
import random

from sparkweave.plans.live import LiveIndex
from sparkweave.plans.index_queries import GLOBS
from sparkweave.sources.extraction import RAW
from sparkweave.sources.tree import Manifest


def node(path, kind, name, line, /, **extra):
    return (path, "node", f"{kind}:{name}", kind, name.rsplit(".", 1)[-1] if kind.endswith("field") else extra.pop("title", name), name, line, None, None, None, json.dumps(extra), 0)


def file_rows(rng, path):
    """A file of one kind, by its directory."""
    n = lambda k: rng.randrange(k)
    kind = path.split("/")[0]
    rows = []
    for i in range(1 + n(3)):
        name, word, fields = f"{path}.{i}", f"w{n(5)}", sorted({f"f{n(6)}" for _ in range(4)})
        if kind == "routes":
            rows.append(node(path, "django.route", name, i, route=f"{word}/<int:pk>/", app=f"app{n(3)}"))
        elif kind == "includes":
            rows.append(node(path, "django.route", name, i, route=rng.choice(["api/", "v1/"]), include=f"app{n(3)}.urls"))
        elif kind == "clients":
            rows.append(node(path, "react.api_client", name, i, raw=f"{rng.choice(['', '/api', '/v1'])}/{word}/${{id}}", generated=n(3) == 0))
        elif kind == "contracts":
            rows.append(node(path, "django.serializer", f"k{n(4)}", i, fields=fields))
            rows.append(node(path, "django.serializer_field", f"k{n(4)}.f{n(6)}", i))
        elif kind == "forms":
            rows.append(node(path, "react.form_schema", name, i, fields=fields, kind=rng.choice(["zod", "graphql-codegen"])))
        else:
            rows.append(node(path, "react.test", name, i, visits=[f"/api/{word}/7", f"/{word}/1"]))
        rows.append((path, "edge", f"{rows[-1][2]}|calls|t:x", "calls", None, None, None, rows[-1][2], rows[0][2], 0.5 + i / 10, None, i))
    return rows


def contents(index):
    g = index.graph()
    return [sorted(map(repr, df.collect())) for df in (g.nodes, g.edges.select("id", "src", "dst", "type", "confidence"), index.residuals())]


def test_follows_random_edits(spark, tmp_path):
    rng = random.Random(2)
    manifest = Manifest([{"name": "c0", "apps": ["app0"]}], generated_clients=list(GLOBS))
    paths = [f"{k}/{i}.x" for k in ("routes", "includes", "clients", "contracts", "forms", "tests") for i in range(3)]
    files = {p: file_rows(rng, p) for p in paths}
    table = lambda files: spark.createDataFrame([r for rows in files.values() for r in rows], RAW)
    hashes = lambda files: spark.createDataFrame([(p, str(hash(str(r))), "other") for p, r in files.items()], "path string, hash string, language string")
    live = LiveIndex(spark, str(tmp_path / "live"), manifest, parts=8).create_from(table(files), hashes(files))
    for _ in range(2):
        edited = rng.sample(paths, 4)
        gone = set(edited[:1])
        fresh = {p: file_rows(rng, p) for p in edited if p not in gone}
        files = {p: r for p, r in files.items() if p not in edited} | fresh
        live.apply(spark.createDataFrame([(p,) for p in edited], "path string"), table(fresh), hashes(fresh))
    whole = LiveIndex(spark, str(tmp_path / "whole"), manifest, parts=3).create_from(table(files), hashes(files))
    got, want = contents(live), contents(whole)
    assert got == want
    assert len(want[1]) > 10 and len(want[2]) > 3
    asked = spark.createDataFrame([(files[paths[0]][0][2],)], "id string")
    plan = live.lookup("nodes", asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan or "PartitionFilters: [isnotnull(part" in plan


def test_changed_files_are_followed(spark, tmp_path):
    from pyspark.sql import functions as F

    live = LiveIndex(spark, str(tmp_path / "i"), parts=4)
    first = spark.createDataFrame([("a/models.py", "from django.db import models\nclass A(models.Model):\n    pass\n"), ("b/models.py", "from django.db import models\nclass B(models.Model):\n    pass\n")], "path string, content string")
    live.create(first)
    assert live.update(first) == 0
    assert live.update(first.where("path = 'a/models.py'").withColumn("content", F.replace("content", F.lit("class A"), F.lit("class C")))) == 2
    assert {r["id"] for r in live.read("nodes").where("type = 'django.model'").collect()} == {"django.model:a.C"}
