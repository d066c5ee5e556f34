"""Source trees, ownership rules, API descriptions, manifests and git history as DataFrames."""

from __future__ import annotations

import json
import os
import re
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from sparkweave.functions.paths import in_skipped_dir
from sparkweave.functions.urls import route_template
from sparkweave.operators import layout
from sparkweave.operators.evolution import split_patches
from sparkweave.sources import tree_source


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), content (text) of all files, listed and read by the executors; hidden and skipped directories aren't entered.

    A root in a store that only Spark's readers reach (one with a scheme other than ``file``) is listed whole, and
    what lies in such directories is dropped then.
    """
    if "://" not in root or root.startswith("file://"):
        tree_source.register(spark)
        return spark.read.format("source_tree").load(root).select("path", "content")
    inside = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(inside.alias("path"), F.col("content").cast("string").alias("content")).where(~in_skipped_dir(inside))


@dataclass
class Manifest:
    """Contexts (name, apps, ui paths, public API, owners), enabled rules, waivers and globs of generated clients."""

    contexts: list[dict] = field(default_factory=list)
    rules: list[str] | None = None
    waivers: list[dict] = field(default_factory=list)
    generated_clients: list[str] = field(default_factory=list)
    #: Keys of the file that mean nothing here; they are written back as they were.
    others: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Manifest:
        """From JSON, or YAML where a parser is installed; keys that are missing mean none, ``rules`` the defaults."""
        data = _load(text) or {}
        own = {"contexts": data.get("contexts") or [], "rules": data.get("rules"), "waivers": data.get("waivers") or [], "generated_clients": data.get("generated_clients") or []}
        return cls(**own, others={k: v for k, v in data.items() if k not in own})

    def write(self) -> str:
        return json.dumps({"contexts": self.contexts, "rules": self.rules, "waivers": self.waivers, "generated_clients": self.generated_clients} | self.others, indent=2)

    def globs(self, spark: SparkSession) -> DataFrame:
        """pattern of files that hold generated clients."""
        return spark.createDataFrame([(g,) for g in self.generated_clients], "pattern string")

    def ui_paths(self, spark: SparkSession) -> DataFrame:
        """prefix, context, pos of UI directories, in the order of the contexts."""
        rows = [(p, c["name"]) for c in self.contexts for p in c.get("ui") or []]
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "prefix string, context string, pos int")

    def waive(self, rule: str, node: str | None, reason: str) -> bool:
        """Whether the waiver is new."""
        if any((w["rule"], w.get("node")) == (rule, node) for w in self.waivers):
            return False
        self.waivers.append({"rule": rule, "node": node, "reason": reason})
        return True

    def apps(self, spark: SparkSession) -> DataFrame:
        """app, context: the first context that names an app."""
        first: dict[str, str] = {}
        for c in self.contexts:
            for a in c.get("apps") or []:
                first.setdefault(a, c["name"])
        return spark.createDataFrame(list(first.items()), "app string, context string")

    def apis(self, spark: SparkSession) -> DataFrame:
        """context, path, pos of published APIs."""
        rows = [(c["name"], re.sub(r"^[A-Za-z]+\s+", "", a), i) for i, c in enumerate(self.contexts) for a in c.get("public_api") or []]
        return spark.createDataFrame(rows, "context string, path string, pos int")

    def owners(self, spark: SparkSession) -> DataFrame:
        rows = [(c["name"], o, i) for c in self.contexts for i, o in enumerate(c.get("owners") or [])]
        return spark.createDataFrame(rows, "context string, owner string, pos int")

    def waiver_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(w["rule"], w.get("node")) for w in self.waivers], "rule string, node string")


def _load(text: str) -> dict | None:
    if not text.strip() or text.lstrip()[0] in "{[":
        return json.loads(text) if text.strip() else None
    try:
        import yaml
    except ImportError as e:
        raise ValueError("the manifest isn't JSON, and no YAML parser is installed") from e
    return yaml.safe_load(text)


def find_manifest(start: str, names: tuple[str, ...] = ("sparkweave.json", "sparkweave.yml")) -> str | None:
    """The manifest of the nearest directory upwards that has one."""
    folder = os.path.abspath(start)
    while True:
        for name in names:
            if os.path.isfile(f"{folder}/{name}"):
                return f"{folder}/{name}"
        if folder == (folder := os.path.dirname(folder)):
            return None


def write_draft(root: str, manifest: Manifest, overwrite: bool = False) -> bool:
    """Whether it was written: an existing one stays unless told otherwise."""
    path = os.path.join(root, "sparkweave.json")
    if os.path.exists(path) and not overwrite:
        return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(manifest.write())
    return True


def draft_manifest(files: DataFrame) -> Manifest:
    """A context for each name of apps and UI features, owned by a team of that name; one row a context comes to the driver."""
    rows = layout.contexts(layout.layout(files)).orderBy("name").collect()
    return Manifest([{"name": r["name"], "apps": r["apps"], "ui": r["ui"], "owners": [f"{r['name']}-team"]} for r in rows] or [{"name": "app", "apps": [], "ui": [], "owners": ["app-team"]}])


def parse_codeowners(text: str) -> list[tuple[str, list[str]]]:
    """Pattern and owners of each rule, in order."""
    lines = (re.split(r"(?:^|\s)#", line, maxsplit=1)[0].split() for line in text.splitlines())
    return [(parts[0], parts[1:]) for parts in lines if len(parts) > 1]


# What an API description calls its operations.
HTTP_METHODS = ("get", "post", "put", "patch", "delete", "head", "options")


def openapi_operations(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """path (a template), method, operation of API descriptions (column content), in JSON or in the block style of YAML.

    JSON is read by its schema. YAML is told line by line: paths, methods and operation names by indents, as
    generators write them; flow style, anchors and references aren't followed.
    """
    kind = "struct<paths:map<string,map<string,struct<operationId:string>>>>"
    is_json = F.col("content").rlike(r"^\s*\{")
    paths = documents.where(is_json).select(F.explode(F.from_json("content", kind)["paths"]).alias("path", "methods"))
    rows = paths.select("path", F.explode("methods").alias("method", "o")).select("path", F.lower("method").alias("method"), F.col("o.operationId").alias("operation"))
    block = _block_events(documents.where(~is_json)).groupBy("path", "method").agg(F.max("operation").alias("operation"))
    found = rows.unionByName(block).where(F.col("method").isin(*HTTP_METHODS))
    return found.select(route_template(F.col("path")).alias("path"), F.upper("method").alias("method"), "operation").distinct()


def _block_events(documents: DataFrame) -> DataFrame:
    """path, method, operation (null but where it is named) of the ``paths`` blocks of YAML texts.

    Lines are rows that learn by windows over their text where they stand: in a section by the last key without an
    indent; a line no deeper than those before it in the section is a path, one no deeper than those before it under the
    path a method. So the work is in proportion to a text's length.
    """
    pattern = r"^( *)(?:'([^']*)'|\"([^\"]*)\"|([^'\"#\s][^#]*?)):(?:\s+(.*?))?\s*$"

    def part(n: int) -> Column:
        return F.regexp_extract("line", pattern, n)

    def so_far(*keys: str) -> WindowSpec:
        return Window.partitionBy("text", *keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)

    texts = documents.select("content").distinct()  # equal texts say the same
    # hashed before they are split, so that no line carries its text along
    texts = texts.select(F.sha2("content", 256).alias("text"), F.split("content", r"\r?\n").alias("lines"))
    lines = texts.select("text", F.posexplode("lines").alias("at", "line")).where(F.col("line").rlike(pattern))
    lines = lines.select("text", "at", F.length(part(1)).alias("indent"), F.concat(part(2), part(3), part(4)).alias("key"), F.regexp_replace(part(5), r"^['\"]|['\"]$", "").alias("value"))
    top = F.col("indent") == 0
    lines = lines.withColumn("section", F.count_if(top).over(so_far())).withColumn("head", F.last(F.when(top, F.col("key")), True).over(so_far())).where((F.col("head") == "paths") & ~top)
    is_path = F.col("indent") == F.min("indent").over(so_far("section"))
    lines = lines.withColumn("is_path", is_path).withColumn("nth", F.count_if("is_path").over(so_far("section"))).withColumn("path", F.last(F.when(F.col("is_path"), F.col("key")), True).over(so_far("section"))).where("not is_path")
    is_method = F.col("indent") == F.min("indent").over(so_far("section", "nth"))
    lines = lines.withColumn("is_method", is_method).withColumn("method", F.last(F.when(F.col("is_method"), F.lower("key")), True).over(so_far("section", "nth")))
    return lines.where("is_method or key = 'operationId'").select("path", "method", F.when(~F.col("is_method"), F.col("value")).alias("operation"))


def _git(root: str, *args: str, timeout: int = 30) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout, check=True).stdout


def git_log(spark: SparkSession, root: str, limit: int = 250) -> DataFrame:
    """sha, author, file of the newest commits, merges left out."""
    rows, sha, author = [], "", ""
    for line in _git(root, "log", f"-n{limit}", "--no-merges", "--name-only", "--pretty=format:%x01%H%x09%an").splitlines():
        if line.startswith("\x01"):
            sha, _, author = line[1:].partition("\t")
        elif line.strip():
            rows.append((sha, author, line.strip()))
    return spark.createDataFrame(rows, "sha string, author string, file string")


def git_diff(spark: SparkSession, root: str, base: str, head: str | None = None, three_dot: bool = True) -> DataFrame:
    """path, status, added, deleted, patch between two revisions, or a revision and the worktree.

    Three dots compare with the merge base; without one, two dots are taken.
    """
    def span(dots: str) -> list[str]:
        return [f"{base}{dots}{head}"] if head else [base]

    if head and three_dot:
        try:
            _git(root, "merge-base", base, head)
        except subprocess.CalledProcessError:
            three_dot = False
    at = span("..." if three_dot else "..")
    status = [(line.split("\t")[-1], line[0]) for line in _git(root, "diff", "--name-status", *at).splitlines()]
    counts = [(p, int(a) if a != "-" else 0, int(d) if d != "-" else 0) for a, d, p in (line.split("\t", 2) for line in _git(root, "diff", "--numstat", "--no-renames", *at).splitlines())]
    patches = split_patches(spark.createDataFrame([(_git(root, "diff", "--no-renames", *at),)], "patch string"))
    rows = spark.createDataFrame(status, "path string, status string").join(spark.createDataFrame(counts, "path string, added int, deleted int"), "path", "left")
    return rows.join(patches, "path", "left")


def git_worktree_diff(spark: SparkSession, root: str) -> DataFrame:
    """Like git_diff against HEAD, files that git doesn't know yet included as added."""
    new = []
    for path in _git(root, "ls-files", "--others", "--exclude-standard").splitlines():
        with open(f"{root}/{path}", encoding="utf-8", errors="replace") as f:
            lines = f.read().splitlines()
        patch = f"diff --git a/{path} b/{path}\n--- /dev/null\n+++ b/{path}\n@@ -0,0 +1,{len(lines)} @@\n" + "\n".join("+" + x for x in lines)
        new.append((path, "A", len(lines), 0, patch))
    known = git_diff(spark, root, "HEAD")
    return known.unionByName(spark.createDataFrame(new, "path string, status string, added int, deleted int, patch string"))


def git_refs(spark: SparkSession, root: str, limit: int = 50) -> DataFrame:
    """kind, name, sha of branches and tags, the newest first."""
    rows = [line.split("\t") for line in _git(root, "for-each-ref", "--sort=-creatordate", f"--count={limit}", "--format=%(refname)%09%(objectname)", "refs/heads", "refs/tags").splitlines()]
    return spark.createDataFrame([("branch" if r.startswith("refs/heads/") else "tag", r.split("/", 2)[2], s) for r, s in rows], "kind string, name string, sha string")


def git_dirty(spark: SparkSession, root: str) -> DataFrame:
    """path of what the worktree changes; of a rename the new name."""
    rows = [(line[3:].split(" -> ")[-1].strip('"'),) for line in _git(root, "status", "--porcelain").splitlines()]
    return spark.createDataFrame(rows, "path string")


def resolve_range(root: str, base: str, head: str = "HEAD") -> tuple[str, str]:
    """The merge base (the base itself if there is none) and the head, as hashes."""
    head = _git(root, "rev-parse", head).strip()
    try:
        return _git(root, "merge-base", base, head).strip(), head
    except subprocess.CalledProcessError:
        return _git(root, "rev-parse", base).strip(), head


def list_directory(path: str, most: int = 400) -> list[dict]:
    """Child directories, those with a repository first."""
    found = [{"name": e.name, "path": e.path, "is_git": os.path.isdir(f"{e.path}/.git")} for e in os.scandir(path) if e.is_dir() and not e.name.startswith(".")]
    return sorted(found, key=lambda d: (not d["is_git"], d["name"].lower()))[:most]
