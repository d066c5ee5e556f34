"""Entry points that compose the operators: index a tree, review a change, what-if, architecture snapshot.

Each returns DataFrames; only the final document of a review is collected, with its lists cut to what a
reader can take in.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions.paths import is_skippable, is_source
from sparkweave.operators import evolution, rules, score, traverse
from sparkweave.operators.graph import Graph, first_seen, index_drift
from sparkweave.operators.scratch import Scratch
from sparkweave.plans import stitching
from sparkweave.schema import SINK_TYPES
from sparkweave.sources import extraction
from sparkweave.sources.store import Store, fingerprint
from sparkweave.sources.tree import Manifest


@dataclass
class Index:
    graph: Graph
    files: DataFrame
    residuals: DataFrame
    #: What the files gave, row by row, and the API's operations: a later index starts from them.
    raw: DataFrame | None = None
    operations: DataFrame | None = None


def index_tree(files: DataFrame, manifest: Manifest | None = None, operations: DataFrame | None = None) -> Index:
    """Extract, fold, stitch and prune the files of a tree (path, content)."""
    scratch = Scratch(files.sparkSession)
    files = extraction.source_files(files)
    return assembled(scratch.cut(extraction.extract(files)), scratch.cut(extraction.files_table(files)), manifest, operations)


def assembled(raw: DataFrame, files: DataFrame, manifest: Manifest | None, operations: DataFrame | None) -> Index:
    """The index of raw rows (a written table): folded, stitched and pruned."""
    spark, manifest = raw.sparkSession, manifest or Manifest()
    scratch = Scratch(spark)
    graph, residuals = extraction.to_graph(raw, manifest.apps(spark), manifest.ui_paths(spark))
    nodes, edges = graph.nodes, scratch.cut(graph.edges)
    if operations is not None:
        nodes = nodes.unionByName(stitching.operation_nodes(operations), True)
    nodes = scratch.cut(nodes)
    more, missing = stitching.stitched(Graph(nodes, edges), manifest.globs(spark))
    graph = Graph(nodes, edges.unionByName(more.join(edges.select("id"), "id", "left_anti"))).pruned()
    return Index(Graph(nodes, scratch.cut(graph.edges)), files, scratch.cut(residuals.unionByName(missing)), raw, operations)


def reindex(old: Index, files: DataFrame, manifest: Manifest | None = None, operations: DataFrame | None = None) -> Index:
    """The index after a change: only files whose hash is new are read; rows of changed and removed files go.

    Folding, stitching and pruning run over all rows again; ``plans.live`` keeps an index in which they don't.
    ``operations``: the old ones, if none are given.
    """
    scratch = Scratch(files.sparkSession)
    files = extraction.source_files(files)
    now = scratch.cut(extraction.files_table(files))
    drift = scratch.cut(index_drift(old.files, now))
    if operations is None and drift.isEmpty():
        return old
    fresh = files.join(drift.where("change <> 'deleted'").select("path"), "path", "left_semi")
    raw = old.raw.join(drift.select("path"), "path", "left_anti").unionByName(extraction.extract(fresh))
    return assembled(scratch.cut(raw), now, manifest, old.operations if operations is None else operations)


@dataclass
class Review:
    impact: Graph
    seeds: DataFrame
    clusters: DataFrame
    findings: DataFrame
    confidence: DataFrame
    kinds: DataFrame
    roles: DataFrame
    marks: DataFrame
    order: DataFrame
    residuals: DataFrame
    document: dict


def review(spark: SparkSession, index: Index, diff: DataFrame, manifest: Manifest | None = None, commits: DataFrame | None = None, hops: int = 8, limit: int = 24) -> Review:
    """What a change (path, patch) reaches, what speaks against it, and how sure that is."""
    manifest, scratch, graph = manifest or Manifest(), Scratch(spark), index.graph
    paths = diff.where(~is_skippable(F.col("path"))).select("path").distinct()
    seeds = scratch.cut(graph.in_files(paths).select("id", "type", "name", "qualified_name", "file_path", "context"))
    walked = traverse.impact_walk(graph, seeds, hops)
    impact = Graph(scratch.cut(walked.nodes), scratch.cut(walked.edges))
    enabled = tuple(manifest.rules) if manifest.rules is not None else rules.RULES
    if enabled:
        found = rules.evaluate(graph, manifest.apps(spark), manifest.apis(spark), enabled, manifest.waiver_table(spark))
    else:
        found = spark.createDataFrame([], "rule string, severity string, node_id string, file_path string, subject string, other_context string, waived boolean")
    on_path = impact.nodes.select(F.col("id").alias("node_id"))
    in_diff = paths.select(F.col("path").alias("file_path"))
    found = found.join(on_path.withColumn("on_path", F.lit(True)), "node_id", "left").join(in_diff.withColumn("in_diff", F.lit(True)), "file_path", "left").where("on_path or in_diff").drop("on_path", "in_diff")
    found = scratch.cut(found)
    weak = score.path_residuals(impact).select("what")
    touched = paths.unionByName(impact.nodes.where("file_path is not null").select(F.col("file_path").alias("path"))).distinct()
    changed = evolution.patch_identifiers(diff)
    unsaid = score.untested_fields(impact, changed).select(F.concat(F.lit("no test mentions "), "name").alias("what"))
    shown = score.ui_residuals(impact, paths, changed)
    residuals = scratch.cut(index.residuals.join(touched, "path", "left_semi").select("what").unionByName(weak).unionByName(unsaid).unionByName(shown).distinct())
    confidence = score.score_confidence(impact, found, residuals.count())
    clusters = score.title_of(traverse.change_clusters(impact.edges, seeds), seeds)
    kinds = score.classify_change(impact, found, seeds)
    roles = score.node_roles(impact, seeds)
    marks = score.file_marks(impact, roles)
    order = score.read_order(paths, impact.nodes, is_skippable(F.col("path")))
    sinks = score.sink_coverage(impact)
    c = confidence.first().asDict()
    document = {
        "confidence": c,
        "kinds": sorted(r["kind"] for r in kinds.collect()),
        "contract_break": score.contract_break(impact, diff).first().asDict(),
        "clusters": [r.asDict() for r in clusters.orderBy(F.desc("files"), "title").limit(limit).collect()],
        "findings": [r.asDict() for r in found.orderBy("waived", "severity", "rule", "node_id").limit(limit).collect()],
        "untested": [r.asDict() for r in sinks.where("not covered").orderBy("type", "name").limit(limit).collect()],
        "tests": [r.asDict() for r in score.suggested_tests(sinks.where("not covered")).collect()],
        "read_order": [r["path"] for r in order.where("not skip").orderBy("rank", "path").limit(limit).collect()],
        "reviewers": [r["owner"] for r in score.suggested_reviewers(impact, manifest.owners(spark)).orderBy("context", "owner").collect()],
        "residuals": [r["what"] for r in residuals.orderBy("what").limit(20).collect()],
        "cards": [r.asDict() for r in rules.deepening_cards(found).collect()],
    }
    if commits is not None:
        spots = evolution.hotspots(commits).join(impact.nodes.select(F.col("file_path").alias("file")).distinct(), "file", "left_semi")
        document["hotspots"] = [r.asDict() for r in spots.orderBy(F.desc("commits"), "file").limit(16).collect()]
        files = impact.nodes.where("file_path is not null").groupBy(F.col("file_path").alias("file")).agg(F.min("context").alias("context"))
        sources = commits.where(is_source(F.col("file")))
        pairs = scratch.cut(evolution.couplings(evolution.co_change(sources), files, files))
        document["couplings"] = [r.asDict() for r in pairs.orderBy(F.desc("together"), "a", "b").collect()]
        document["evolution"] = [r.asDict() for r in evolution.notes(spots, pairs).orderBy("kind", F.desc("n"), "subject").limit(limit).collect()]
        document["knowledge"] = [r.asDict() for r in evolution.knowledge_owners(commits.join(files.select("file"), "file", "left_semi")).collect()]
    views = score.auth_path(impact).orderBy("guarded", "name").limit(limit).collect()
    document["auth"] = [v.asDict() for v in views]
    document["sinks"] = [r.asDict() for r in score.sink_summaries(impact).orderBy("type", "name").limit(limit).collect()]
    contexts = [r["context"] for r in impact.nodes.where("context is not null").select("context").distinct().orderBy("context").limit(limit).collect()]
    document["tests_note"], document["architecture_note"] = tests_note(document), architecture_note(document, contexts)
    document["headline"] = headline(document)
    document["checklist"] = checklist(document)
    return Review(impact, seeds, clusters, found, confidence, kinds, roles, marks, order, residuals, document)


def tests_note(document: dict) -> str:
    c, bare = document["confidence"], [u["name"] for u in document["untested"]]
    return f"{c['covered_sinks']} of {c['sinks']} sinks are tested" + (f"; no test reaches {', '.join(bare[:4])}" if bare else "")


def architecture_note(document: dict, contexts: list[str]) -> str:
    """The first blocker, else whether the change stays inside its contexts."""
    blockers = [f for f in document["findings"] if f["severity"] == "blocker" and not f["waived"]]
    if blockers:
        return f"{blockers[0]['rule']}: {blockers[0]['subject']}"
    if "cross_context" in document["kinds"]:
        return "edges cross contexts"
    return f"stays inside {', '.join(contexts)}" if contexts else "no rule is broken"


def auth_note(document: dict) -> str:
    open_ = [v["name"] for v in document["auth"] if not v["guarded"]]
    if not document["auth"]:
        return "no view on the path"
    if open_:
        return f"no permission on {', '.join(open_[:3])}"
    return f"guarded by {', '.join(sorted({p for v in document['auth'] for p in v['permissions']})[:4])}"


def headline(document: dict) -> str:
    """The review in a few lines, one a topic."""
    first = lambda rows, other: rows[0] if rows else other
    by_type: dict[str, list[str]] = {}
    for s in document["sinks"]:
        by_type.setdefault(s["type"], []).append(s["name"])
    sinks = "; ".join(f"{kind} {', '.join(names[:3])}" for kind, names in by_type.items())
    rows = {
        "Sinks": sinks or "none", "Contract": document["contract_break"]["kind"], "Auth": auth_note(document), "Tests": document["tests_note"],
        "Architecture": document["architecture_note"], "Open": first(document["residuals"], "none"), "Reviewers": ", ".join(document["reviewers"]) or "the contexts' owners",
    }
    title = first([c["title"] for c in document["clusters"]], "no node of the graph")
    return "\n".join([f"{document['confidence']['level'].upper()}: {title}", *(f"{k}: {v}" for k, v in rows.items())])


def checklist(document: dict) -> list[dict]:
    """What is left to do, blockers first."""
    todo = [{"kind": "finding", "status": "done" if f["waived"] else "todo", "title": f"{f['severity']}: {f['rule']}", "node_id": f["node_id"]} for f in document["findings"]]
    todo.sort(key=lambda t: (t["status"] == "done", not t["title"].startswith("blocker")))
    if document["contract_break"]["kind"] != "none":
        todo.append({"kind": "contract", "status": "todo" if document["contract_break"]["kind"] == "breaking" else "info", "title": f"contract: {document['contract_break']['kind']}", "node_id": None})
    todo += [{"kind": "auth", "status": "todo", "title": f"no permission on {v['name']}", "node_id": v.get("id")} for v in document["auth"] if not v["guarded"]]
    todo += [{"kind": "history", "status": "info", "title": f"{n['kind']}: {n['subject']}", "node_id": None} for n in document.get("evolution", [])[:8]]
    todo += [{"kind": "reviewer", "status": "info", "title": f"ask {r}", "node_id": None} for r in document["reviewers"][:4]]
    todo += [{"kind": "test", "status": "todo", "title": f"test {u['name']}", "node_id": u["id"]} for u in document["untested"]]
    todo += [{"kind": "residual", "status": "info", "title": r, "node_id": None} for r in document["residuals"][:8]]
    if not any(t["status"] == "todo" for t in todo):
        todo.insert(0, {"kind": "ready", "status": "done", "title": "ready" if document["confidence"]["level"] == "high" else "read the rest", "node_id": None})
    return todo


def gate(document: dict, fail_on: str = "blocker") -> int:
    """Exit code: 2 blockers, 4 a breaking contract, 3 too low a confidence, 0 otherwise."""
    c, contract = document["confidence"], document["contract_break"]["kind"]
    if fail_on == "never":
        return 0
    if c["blockers"]:
        return 2
    if fail_on in ("low", "medium"):
        return 4 if contract == "breaking" else 3 if c["level"] == "low" or c["level"] == fail_on else 0
    return 0


def gate_lines(document: dict, fail_on: str = "blocker") -> str:
    """The gate as key and value lines for CI."""
    c = document["confidence"]
    rows = {"level": c["level"], "passed": str(gate(document, fail_on) == 0).lower(), "contract_break": document["contract_break"]["kind"], "sinks": c["sinks"]}
    return "".join(f"{k}={v}\n" for k, v in rows.items())


def markdown(document: dict) -> str:
    c = document["confidence"]
    lines = [f"# Confidence {c['level']} ({c['score']})", "", *document["headline"].splitlines(), "", f"{c['covered_sinks']} of {c['sinks']} sinks are tested; {c['blockers']} blockers, {c['warnings']} warnings."]
    for title, rows in (("Kinds", document["kinds"]), ("Read first", document["read_order"]), ("To do", [f"{t['title']} ({t['status']})" for t in document["checklist"]]), ("Reviewers", document["reviewers"]), ("Open", document["residuals"])):
        if rows:
            lines += ["", f"## {title}", "", *(f"- {r}" for r in rows)]
    return "\n".join(lines) + "\n"


def html(document: dict) -> str:
    """The markdown brief as a page."""
    out = []
    for line in markdown(document).splitlines():
        mark, _, text = line.partition(" ")
        tag = {"#": "h1", "##": "h2", "-": "li"}.get(mark, "p")
        out.append(f"<{tag}>{escape(text if tag != 'p' else line)}</{tag}>" if line else "")
    return "<!doctype html><meta charset=utf-8>" + "\n".join(out) + "\n"


def findings_version(index: Index, manifest: Manifest) -> str:
    """Findings follow from the files, the described operations, the manifest and the rules' revision."""
    operations = None if index.operations is None else fingerprint(index.operations.select(F.concat_ws(" ", "method", "path").alias("path"), F.lit("").alias("hash")))
    told = json.dumps([manifest.write(), rules.REVISION, operations])
    return f"{fingerprint(index.files)}{hashlib.sha256(told.encode()).hexdigest()[:16]}"


def all_findings(index: Index, manifest: Manifest, store: Store | None = None) -> DataFrame:
    """Findings of the manifest's rules over the whole index; of an unchanged one those that the store keeps."""
    spark = index.files.sparkSession
    enabled = tuple(manifest.rules) if manifest.rules is not None else rules.RULES
    compute = lambda: rules.evaluate(index.graph, manifest.apps(spark), manifest.apis(spark), enabled, manifest.waiver_table(spark))
    return compute() if store is None else store.cached("findings", findings_version(index, manifest), compute)


def architecture_report(index: Index, manifest: Manifest | None = None, store: Store | None = None) -> dict[str, DataFrame]:
    """Counts by type, findings of all rules, and the types' graph."""
    found = all_findings(index, manifest or Manifest(), store)
    return {"types": index.graph.type_counts(), "findings": found, "sinks": index.graph.of_types(*SINK_TYPES), "residuals": first_seen(index.residuals, "what", "path")}


def index_summary(index: Index, manifest: Manifest, store: Store, limit: int = 40) -> dict:
    """What a reader of an index sees first; it is kept as the index's card, and older findings are forgotten."""
    version, found = findings_version(index, manifest), all_findings(index, manifest, store)
    store.forget("findings", version)
    counts = index.graph.counts().first().asDict()
    by_rule = {(r["rule"], r["waived"]): r["count"] for r in found.groupBy("rule", "waived").count().collect()}
    summary = {
        "version": version, "counts": counts, "files": index.files.count(), "types": {r["type"]: r["n"] for r in index.graph.type_counts().collect()},
        "contexts": {c["name"]: {k: c.get(k) or [] for k in ("apps", "ui", "public_api", "owners")} for c in manifest.contexts},
        "rules": list(manifest.rules if manifest.rules is not None else rules.RULES),
        "findings": {rule: n for (rule, waived), n in sorted(by_rule.items()) if not waived}, "waived": sum(n for (_, waived), n in by_rule.items() if waived),
        "deepening": [r.asDict() for r in rules.deepening_cards(found).collect()],
        "residuals": [r["what"] for r in first_seen(index.residuals, "what", "path").limit(limit).collect()],
    }
    store.set_meta("card", json.dumps({k: summary[k] for k in ("version", "counts", "files", "contexts")}))
    return summary


def index_card(store: Store) -> dict:
    """Counts and contexts of the index last summarised, without a look at it."""
    kept = store.get_meta("card")
    return {"indexed": False, "counts": {"nodes": 0, "edges": 0}, "contexts": {}} if kept is None else {"indexed": True} | json.loads(kept)
