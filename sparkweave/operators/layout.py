"""What a tree of files holds: roots of server and UI, apps and features, inferred from paths alone (and package files).

Evidence is rolled up along all directories above a file: a directory is a candidate by what lies below it. The
roots are two rows that come to the driver; apps and features stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.paths import file_name, in_skipped_dir

# Names that layouts are told by.
TEST_DIRS = ("test", "tests", "testing")
UI_ROOTS = ("frontend/src", "frontend", "src-ui/src", "web/src", "client/src", "ui/src", "ui", "src/app")
UI_NAMES = ("frontend", "web", "ui", "client", "src-ui")
OTHER_UIS = ("docs", "documentation", "website", "docusaurus", "storybook", "starlight_help", "e2e", "cypress", "graphiql", "demo-app", "demo", "example", "examples", "legacy", "legacy-ui")
SERVER_ROOTS = ("backend", "server", "api", "app")
NOT_APPS = ("migrations", "tests", "management", "config", "project", "settings")
CONTEXT_OF = {"auth": "identity", "accounts": "identity", "users": "identity"}


def folder_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def ancestors(folder: Column) -> Column:
    """A directory and all above it, the root (an empty name) included."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def _depth(folder: Column) -> Column:
    return F.size(F.filter(F.split(folder, "/"), lambda p: p != ""))


def _among(path: Column, names: tuple[str, ...]) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(*names))


def common_folder(folders: DataFrame) -> DataFrame:
    """folder: the deepest directory that all directories (folder, distinct) lie in."""
    held = folders.select(F.explode(ancestors(F.col("folder"))).alias("above")).groupBy("above").agg(F.count("*").alias("n"))
    total = folders.agg(F.count("*").alias("total"))
    return held.join(F.broadcast(total), F.col("n") == F.col("total")).orderBy(F.desc(_depth(F.col("above")))).limit(1).select(F.col("above").alias("folder"))  # total: one row


def markers(files: DataFrame, name: str) -> DataFrame:
    """folder, app of directories that hold a file of that name and aren't about tests."""
    rows = files.where((file_name(F.col("path")) == name) & ~_among(F.col("path"), TEST_DIRS)).select(folder_of(F.col("path")).alias("folder"))
    rows = rows.withColumn("app", F.substring_index("folder", "/", -1)).where(~F.col("app").isin(*NOT_APPS) & (F.col("app") != ""))
    return rows.distinct()


def _first(rows: DataFrame) -> str | None:
    row = rows.first()
    return row[0] if row else None


def server_root(files: DataFrame) -> str:
    """Where all apps lie; without apps the highest directory with a management script that isn't in a test."""
    parents = markers(files, "apps.py").select(folder_of(F.col("folder")).alias("folder")).distinct()
    found = _first(common_folder(parents))
    if found is None:
        scripts = files.where(file_name(F.col("path")) == "manage.py").select(folder_of(F.col("path")).alias("folder"), _among(F.col("path"), TEST_DIRS).alias("test"))
        found = _first(scripts.orderBy("test", _depth(F.col("folder")), "folder"))
    if found is None:
        tops = files.where(F.instr("path", "/") > 0).select(F.substring_index("path", "/", 1).alias("folder")).where(F.col("folder").isin(*SERVER_ROOTS))
        found = _first(tops.orderBy(F.array_position(F.array(*map(F.lit, SERVER_ROOTS)), F.col("folder"))))
    return SERVER_ROOTS[0] if found is None else found


def ui_root(files: DataFrame) -> str:
    """The first of the usual directories, else the source directory of the package that asks for the UI library."""
    folders = files.select(F.explode(ancestors(folder_of(F.col("path")))).alias("folder")).where(F.col("folder").isin(*UI_ROOTS)).distinct()
    found = _first(folders.orderBy(F.array_position(F.array(*map(F.lit, UI_ROOTS)), F.col("folder"))))
    if found is None and "content" in files.columns:
        asks = [F.get_json_object("content", f"$.{group}['{name}']").isNotNull() for group in ("dependencies", "devDependencies") for name in ("react", "react-dom")]
        packages = files.where((file_name(F.col("path")) == "package.json") & ~_among(F.lower("path"), OTHER_UIS)).where(asks[0] | asks[1] | asks[2] | asks[3]).select(folder_of(F.col("path")).alias("folder"))
        inside = lambda f: F.when(f == "", F.lit("src")).otherwise(F.concat(f, F.lit("/src")))
        sources = files.select(F.explode(ancestors(folder_of(F.col("path")))).alias("source")).distinct()
        rows = packages.join(sources, inside(F.col("folder")) == F.col("source"), "left").withColumn("root", F.coalesce("source", "folder"))
        score = F.when(_among(F.col("root"), UI_NAMES), 10).otherwise(0) + F.when(F.col("source").isNotNull(), 5).otherwise(0)
        found = _first(rows.orderBy(F.desc(score), F.length("root"), "root").select("root"))
    return UI_ROOTS[0] if found is None else found


def below(path: Column, root: str) -> Column:
    return path.startswith(f"{root}/") if root else F.lit(True)


def layout(files: DataFrame) -> DataFrame:
    """kind (root, app, feature), name, root (a directory) of files (path, and content where package files are to be read)."""
    files = files.where(~in_skipped_dir(F.col("path")))
    server, ui = server_root(files), ui_root(files)
    apps = markers(files.where(below(F.col("path"), server)), "apps.py")
    if apps.isEmpty():
        apps = markers(files.where(below(F.col("path"), server)), "models.py")
    inside = F.col("path").startswith(f"{ui}/features/") & (_depth(F.col("path")) > _depth(F.lit(ui)) + 2)
    features = files.where(inside).select(F.split("path", "/")[len(ui.split("/")) + 1].alias("name")).distinct()
    roots = files.sparkSession.createDataFrame([("root", "backend", server), ("root", "frontend", ui)], "kind string, name string, root string")
    rows = roots.unionByName(apps.select(F.lit("app").alias("kind"), F.col("app").alias("name"), F.col("folder").alias("root")))
    return rows.unionByName(features.select(F.lit("feature").alias("kind"), "name", F.concat(F.lit(f"{ui}/features/"), "name").alias("root")))


def contexts(parts: DataFrame) -> DataFrame:
    """name, apps, ui of contexts that a layout suggests: apps and features of one name (or of names that mean the same) belong together."""
    mapping = F.create_map(*(F.lit(x) for pair in CONTEXT_OF.items() for x in pair))
    rows = parts.where("kind <> 'root'").withColumn("context", F.coalesce(mapping[F.col("name")], F.col("name")))
    of = lambda kind, c: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col(c))))
    return rows.groupBy(F.col("context").alias("name")).agg(of("app", "name").alias("apps"), of("feature", "root").alias("ui"))
