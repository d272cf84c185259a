"""Small cases of fused recall, structured saves, task checks and the code graph."""
import re

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import vectors as V
from recallgrid.operators import codegraph, hybrid, vector, workflow
from recallgrid.sources import memory as M

SF = "/root/testdata/sf0.01"


def test_cells_find_most_of_the_exact_neighbours(spark):
    m = M.memories(spark, SF).cache()
    index = hybrid.CellIndex().fit(m)
    assert index.assign(m).count() == m.where("not tombstoned").count()
    hits = 0
    for i in range(0, 500, 50):
        q = [float(x) for x in M.table(spark, SF, "embeddings").where(F.col("vec_id") == i).first()["embedding"]]
        hits += len({r.slot_id for r in index.recall(m, q, 10).collect()} & {r.slot_id for r in vector.recall(m, q, 10).collect()})
    assert hits >= 90


def test_word_buckets(spark):
    texts = ["the cat THE_cat", "", "größe 94% 😀", None]

    def plain(text):
        counts = [0] * 64
        for w in re.findall(r"\w+", text.lower()):
            h = 2166136261
            for c in w:
                h = ((h ^ ord(c)) * 16777619) % 2**32
            counts[h % 64] += 1
        return counts

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.v for r in df.select("id", hybrid.word_buckets(F.col("text")).alias("v")).collect()}
    assert all(got[i] == plain(t) for i, t in enumerate(texts) if t is not None)


def test_word_vectors_read_their_text_once(spark):
    """A text that differs at each evaluation shows how often there was one: five words, and a vector of length one."""
    rows = spark.range(40).select(hybrid.word_buckets(F.uuid()).alias("n"), hybrid.word_vector(F.uuid()).alias("v"), V.normalise(F.array(F.rand(), F.rand())).alias("u")).collect()
    assert {sum(r.n) for r in rows} == {5}
    assert {round(sum(x * x for x in v), 9) for r in rows for v in (r.v, r.u)} == {1.0}


def test_rerank_keeps_order_without_scores(spark):
    hits = spark.createDataFrame([(7, "a", 1), (8, "bb", 2), (9, "c", 3)], "slot_id long, text string, rank int")
    assert [r.slot_id for r in hybrid.rerank(hits, 2).collect()] == [7, 8]
    assert [r.slot_id for r in hybrid.rerank(hits, 3, lambda t: F.when(F.char_length(t) > 1, 1.0)).collect()] == [8, 7, 9]


def test_hops(spark):
    rows = [(i, v, False, False) for i, v in ((0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]))]
    m = spark.createDataFrame(rows, "slot_id long, vector array<float>, tombstoned boolean, superseded boolean")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    seeds = m.where("slot_id = 0").select("slot_id")
    assert [sorted(r.slot_id for r in hybrid.reach(e, seeds, h).collect()) for h in (0, 1, 2, 9)] == [[0], [0, 1], [0, 1, 2], [0, 1, 2]]
    assert [r.slot_id for r in hybrid.recall_with_hops(m, e, [1.0, 0.0], 3, 2).collect()] == [0, 1, 2]


def test_versions(spark):
    log = spark.createDataFrame([(1, "save", "a"), (2, "save", "a"), (3, "delete", "a"), (4, "delete", "a"), (5, "save", "b"), (6, "delete", "c")], "seq long, op string, memory_id string")
    assert sorted(map(tuple, workflow.versions(log).collect())) == [(1, "a", False, False), (2, "a", True, True), (5, "b", True, False)]


@pytest.mark.parametrize(("a", "b", "hit"), [("src/**", "src/api/x.py", True), ("src/a*", "src/b*", False), ("**", "any", True), ("docs", "docs/x", True)])
def test_path_overlap(spark, a, b, hit):
    assert spark.range(1).select(workflow.paths_overlap(F.array(F.lit(a)), F.array(F.lit(b)))).first()[0] is hit


def test_chain_faults(spark):
    rows = [("1", i, "r", "started", f"2024-01-0{i}", "t", '{"a":1}') for i in (1, 2, 3, 4)]
    log = workflow.chained(spark.createDataFrame(rows, ["log_id", *workflow.EVENT_FIELDS]))
    heads = log.groupBy("log_id").agg(F.max_by("event_hash", "sequence").alias("head"))
    assert workflow.chain_issues(log, "r", heads).count() == 0
    for c in ("payload", "event_type", "timestamp", "task_id"):
        edited = log.withColumn(c, F.when(F.col("sequence") == 2, "{}").otherwise(F.col(c)))
        assert [tuple(r) for r in workflow.chain_issues(edited, "r", heads).collect()] == [("1", 2, "hash")]
    cut = log.where("sequence <> 2")
    assert sorted(r.issue for r in workflow.chain_issues(cut, "r", heads).collect()) == ["previous", "sequence"]
    assert [tuple(r) for r in workflow.chain_issues(log.where("sequence < 4"), "r", heads).collect()] == [("1", 3, "head")]
    assert [tuple(r) for r in workflow.chain_issues(log.limit(0), "r", heads).collect()] == [("1", 0, "head")]


def test_later_empty_risks_clear(spark):
    points = spark.createDataFrame([(1, 1, '[{"id":"x","severity":"HIGH"}]'), (1, 2, "[]"), (2, 1, '[{"severity":"low"},{"id":"y","high_risk":true}]'), (3, 1, '[{"id":"z"}]'), (4, 1, None)], "task_id long, sequence long, open_risks string")
    tasks = spark.createDataFrame([(1, "high"), (2, "low"), (3, "low"), (4, "high")], "task_id long, risk string")
    assert sorted(map(tuple, workflow.unresolved_risks(points, tasks).collect())) == [(2, 1, 1, "unnamed risk"), (2, 1, 2, "y")]


def test_code_graph(spark):
    files = [("a.py", "import os\nfrom . import b\nclass K:\n    def run(self):\n        return help()\ndef help():\n    return missing()\nhelp()\n"), ("b.py", "def help():\n    pass\n"), ("bad.py", "def ("), ("none.py", None)]
    rows = codegraph.symbols(spark.createDataFrame(files, "file_path string, source string"))
    links, nodes = codegraph.edges(rows), codegraph.nodes(rows)
    assert {r.qualified_name for r in nodes.collect()} == {"a.py::K", "a.py::K.run", "a.py::help", "b.py::help"}
    calls = {(r.source, r.target) for r in links.where("kind = 'CALLS'").collect()}
    assert calls == {(s, t) for s in ("a.py::K.run", "a.py::<module>") for t in ("a.py::help", "b.py::help")}
    assert [r.qualified_name for r in codegraph.callers_of(links, nodes, "help").collect()] == ["a.py::K.run"]
    assert {r.target for r in links.where("kind = 'IMPORTS'").collect()} == {"os", "."}
    assert rows.where("row = 'error'").count() == 1


def test_transcript_keeps_the_end(spark):
    blocks = spark.createDataFrame([("s", 1, "user", "hello"), ("s", 2, "assistant", "x" * 50), ("s", 3, "tool", " ok "), ("s", 4, "user", None)], "session string, ordinal int, role string, text string")
    whole = "User: hello\nAssistant: " + "x" * 10 + "…[truncated]\n  -> ok"
    assert workflow.transcript(blocks, 10, 1000).first().text == whole
    assert workflow.transcript(blocks, 10, 8).first().text == whole[-8:]
