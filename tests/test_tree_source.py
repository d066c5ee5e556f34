"""The tree source enters only what can hold wanted files."""

import time

from pyspark.sql import functions as F

from sparkweave.sources import tree, tree_source
from sparkweave.sources.tree_source import Wanted


def make(root, files):
    for path, text in files.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text if isinstance(text, bytes) else text.encode())


def junk(root, packages=80, each=40):
    make(root, {f"node_modules/p{i}/f{k}.js": "x" for i in range(packages) for k in range(each)} | {"src/app.py": "x = 1\n"})


def test_skipped_directories_are_never_listed(tmp_path):
    junk(tmp_path)
    make(tmp_path, {".git/objects/a": "x", "src/dist/b.js": "x", "src/docs/x/c.py": "x"})
    seen = []
    began = time.time()
    found = list(tree_source.below(str(tmp_path), "", Wanted(), seen))
    assert time.time() - began < 0.4
    assert found == [("src/app.py", 6)] and seen == ["", "src"]


def test_reads_what_is_there(spark, tmp_path):
    make(tmp_path, {f"a{i}/b/c{k}.py": f"v = {i}{k}\r\n" for i in range(7) for k in range(3)} | {"top.py": "t", "a0/bad.py": b"\xff\xfe", "ü/ö.py": "ä", "a1/.hid/x.py": "h"})
    got = {r["path"]: r["content"] for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert len(got) == 24 and got["a3/b/c1.py"] == "v = 31\r\n" and got["ü/ö.py"] == "ä" and "�" in got["a0/bad.py"]
    assert tree.read_tree(spark, f"{tmp_path}/none").count() == 0
    assert spark.read.format("source_tree").option("parts", 3).load(f"file://{tmp_path}").rdd.getNumPartitions() >= 3
    (tmp_path / "loop").symlink_to(tmp_path)
    assert tree.read_tree(spark, str(tmp_path)).count() == 24


def test_filters_reach_the_source(spark, tmp_path):
    make(tmp_path, {f"a{i}/b/c{k}.{e}": "x" * k for i in range(5) for k in range(4) for e in ("py", "txt")})
    tree_source.register(spark)
    rows = spark.read.format("source_tree").option("content", "false").load(str(tmp_path))
    some = rows.where(F.col("path").startswith("a3/") & F.col("path").endswith(".py") & (F.col("size") <= 2))
    assert sorted(r["path"] for r in some.collect()) == ["a3/b/c0.py", "a3/b/c1.py", "a3/b/c2.py"]
    assert all(r["content"] is None for r in some.collect())
    assert rows.where(F.col("path").isin("a1/b/c1.py", "a2/none.py")).count() == 1
    reader = tree_source.TreeReader(str(tmp_path), 64, True)
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringStartsWith

    left = list(reader.pushFilters([StringStartsWith(("path",), "a3/"), IsNotNull(("path",)), EqualTo(("content",), "x")]))
    assert left == [IsNotNull(("path",)), EqualTo(("content",), "x")]
    seen = []
    assert len(list(tree_source.below(str(tmp_path), "", reader.wanted, seen))) == 8 and seen == ["", "a3", "a3/b"]
