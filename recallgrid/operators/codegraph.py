"""Symbols, calls and imports of Python sources, and queries over them."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ROWS = "file_path string, row string, kind string, name string, qualified_name string, line int"


def _parse(batches):
    import ast

    import pyarrow as pa

    def walk(node, path, scope, owner, out):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{scope}.{child.name}" if scope else child.name
                out.append((path, "node", "CLASS" if isinstance(child, ast.ClassDef) else "FUNCTION", child.name, f"{path}::{inner}", child.lineno))
                walk(child, path, inner, owner if isinstance(child, ast.ClassDef) else f"{path}::{inner}", out)
                continue
            if isinstance(child, ast.Call):
                name = getattr(child.func, "attr", None) or getattr(child.func, "id", None)
                if name:
                    out.append((path, "call", "CALLS", name, owner, child.lineno))
            elif isinstance(child, ast.Import):
                out.extend((path, "import", "IMPORTS", a.name, path, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append((path, "import", "IMPORTS", "." * child.level + (child.module or ""), path, child.lineno))
            walk(child, path, scope, owner, out)

    for b in batches:
        out: list = []
        for path, source in zip(b.column("file_path").to_pylist(), b.column("source").to_pylist()):
            try:
                tree = ast.parse(source or "")
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                out.append((path, "error", "ERROR", "", path, 0))
                continue
            held = len(out)
            try:
                walk(tree, path, "", f"{path}::<module>", out)
            except RecursionError:
                out[held:] = [(path, "error", "ERROR", "", path, 0)]
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:5]), pa.array(cols[5], pa.int32())], names=["file_path", "row", "kind", "name", "qualified_name", "line"])


def symbols(sources: DataFrame) -> DataFrame:
    """One row a symbol ('node'), call, import or unreadable file ('error') of (file_path, source)."""
    return sources.select("file_path", "source").mapInArrow(_parse, _ROWS)


def nodes(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'node'").select("kind", "name", "qualified_name", "file_path", "line")


def edges(rows: DataFrame) -> DataFrame:
    """kind, source, target, file_path, line: a call to each symbol of its bare name, unresolved ones dropped; and the imports."""
    named = nodes(rows).select("name", F.col("qualified_name").alias("target"))
    calls = rows.where("row = 'call'").join(named, "name").select("kind", F.col("qualified_name").alias("source"), "target", "file_path", "line")
    return calls.unionByName(rows.where("row = 'import'").select("kind", F.col("qualified_name").alias("source"), F.col("name").alias("target"), "file_path", "line"))


def _named(column: str, name: str):
    return F.col(column).ilike(f"%::{name}")


def callers_of(links: DataFrame, symbols_: DataFrame, name: str) -> DataFrame:
    """Symbols that call it; a call at module level has none."""
    hit = links.where((F.col("kind") == "CALLS") & _named("target", name)).select(F.col("source").alias("qualified_name"))
    return symbols_.join(hit, "qualified_name", "left_semi").select("qualified_name", "file_path").distinct()


def callees_of(links: DataFrame, symbols_: DataFrame, name: str) -> DataFrame:
    hit = links.where((F.col("kind") == "CALLS") & _named("source", name)).select(F.col("target").alias("qualified_name"))
    return symbols_.join(hit, "qualified_name", "left_semi").select("qualified_name", "file_path").distinct()


def fingerprint(sources: DataFrame) -> DataFrame:
    """repo, fingerprint: sha256 over path, NUL and the content's sha256, NUL, in the order of paths.

    Contents are hashed apart, so one row holds a repository's paths and digests only.
    """
    rows = sources.select("repo", F.struct("file_path", F.sha2(F.coalesce("source", F.lit("")), 256).alias("sha")).alias("x"))
    part = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(x["file_path"], F.lit("\0"), x["sha"], F.lit("\0")))
    return rows.groupBy("repo").agg(F.sha2(F.array_join(part, ""), 256).alias("fingerprint"))


def fresh(receipts: DataFrame, current: DataFrame) -> DataFrame:
    """repo, fresh: the recorded fingerprint is the current one."""
    now = current.select("repo", F.col("fingerprint").alias("now"))
    return receipts.join(now, "repo", "left").select("repo", F.coalesce(F.col("fingerprint") == F.col("now"), F.lit(False)).alias("fresh"))


def status(symbols_: DataFrame, links: DataFrame, language: str = "python") -> DataFrame:
    """One row: how many nodes, edges and files there are, and the languages."""
    n = symbols_.agg(F.count("*").alias("nodes"), F.count_distinct("file_path").alias("files"), F.when(F.count("*") > 0, language).otherwise("").alias("languages"))
    return n.crossJoin(links.agg(F.count("*").alias("edges")))


def query_terms(objective: str) -> list[str]:
    import re

    return sorted({w for w in re.findall(r"[a-z0-9_]+", objective.lower()) if len(w) >= 3})


def graph_slice(symbols_: DataFrame, links: DataFrame, objective: str, terms: int = 8, each: int = 8, nodes_cap: int = 16, edges_cap: int = 24) -> tuple[DataFrame, DataFrame]:
    """The part of the graph that an objective names: nodes and edges, each with its place.

    The first ``each`` nodes (by file and line) of each of the first ``terms`` terms, repeats dropped, the first
    ``nodes_cap``; then the first ``each`` edges at each of the first ``each`` nodes, the first ``edges_cap``.
    """
    asked = symbols_.sparkSession.createDataFrame([(i, t) for i, t in enumerate(query_terms(objective)[:terms])], "term_at int, term string")
    named = F.lower("name").contains(F.col("term")) | F.lower("qualified_name").contains(F.col("term"))
    by_file = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("file_path", "line", "qualified_name"))
    hit = symbols_.join(F.broadcast(asked), named).withColumn("rn", by_file("term_at")).where(F.col("rn") <= each)
    first = hit.groupBy("qualified_name", "file_path", "line").agg(F.min(F.struct("term_at", "rn")).alias("seen"))
    top = first.orderBy("seen", "qualified_name").limit(nodes_cap)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("seen", "qualified_name"))  # nodes_cap rows
    nodes_ = top.withColumn("place", place).select("place", "qualified_name", "file_path", "line")
    heads = nodes_.where(F.col("place") <= each).select("place", "qualified_name")
    ends = links.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("qualified_name"), "kind", "source", "target", "file_path", "line")
    w = Window.partitionBy("place").orderBy("file_path", "line", "kind", "source", "target")
    near = ends.join(F.broadcast(heads), "qualified_name").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= each)
    once = near.groupBy("kind", "source", "target", "file_path", "line").agg(F.min(F.struct("place", "rn")).alias("seen"))
    return nodes_, once.orderBy("seen").limit(edges_cap).drop("seen")
