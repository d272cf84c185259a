"""Behaviour that the catalog's tables don't show."""
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recallgrid.functions import text as T
from recallgrid.operators import filters, graph, integrity, lexical, oplog, vector
from recallgrid.sources import memory as M
from recallgrid.streaming import index

SCHEMA = "slot_id long, text string, vector array<float>, entity_bitmap long, layer int, created_at_ns long, valid_from_ns long, tombstoned boolean, superseded boolean"


def memories(spark, rows):
    return spark.createDataFrame([(i, t, [float(x) for x in v], b, la, c, f, dead, old) for i, (t, v, b, la, c, f, dead, old) in enumerate(rows)], SCHEMA)


def test_cosine_order_and_delete(spark):
    m = memories(spark, [("near", [1.0, 0, 0, 0], 1, 0, 0, 0, False, False), ("mid", [0.7, 0.7, 0, 0], 1, 0, 0, 0, False, False), ("far", [0.0, 0, 0, 1], 1, 0, 0, 0, False, False), ("none", [0.0, 0, 0, 0], 1, 0, 0, 0, False, False)])
    assert [r.slot_id for r in vector.recall(m, [1.0, 0, 0, 0], 4).collect()] == [0, 1, 2, 3]
    dead = m.withColumn("tombstoned", F.col("slot_id") == 0)
    assert [r.slot_id for r in vector.recall(dead, [1.0, 0, 0, 0], 9).collect()] == [1, 2, 3]
    assert vector.recall(m, [1.0, 0, 0, 0], 0).count() == 0
    with pytest.raises(PySparkException):
        vector.recall(m, [1.0, 0], 2).collect()


def test_filters(spark):
    m = memories(spark, [("a", [1.0], 1, 0, 100, 7, False, False), ("b", [1.0], 2, 1, 200, 8, False, False)])
    ids = lambda **how: [r.slot_id for r in m.where(filters.where(**how)).collect()]
    assert ids(entity_mask=2) == [1] and ids(entity_mask=0) == [] and ids(created=(150, 300)) == [1] and ids(valid=(7, 7)) == [0] and ids(layer=-1) == [0, 1]


def test_batch_recall_matches_single(spark):
    rng = np.random.default_rng(3)
    m = memories(spark, [(str(i), rng.normal(size=8).tolist(), 1, 0, 0, 0, i % 9 == 0, False) for i in range(300)])
    q = rng.normal(size=8).tolist()
    asked = spark.createDataFrame([(5, q)], "query_id long, vector array<double>")
    one = [r.slot_id for r in vector.recall(m, q, 10).collect()]
    assert [r.slot_id for r in vector.recall_batch(m, asked, 10).orderBy("rank").collect()] == one
    pq = vector.ProductQuantizer(4, 16).train(m)
    assert len({r.slot_id for r in pq.recall(m, q, 10).collect()} & set(one)) >= 9
    with pytest.raises(ValueError):
        vector.ProductQuantizer().recall(m, q, 3)


def test_quantised_recall_of_all_registered_queries(spark):
    from recallgrid.plans import ledger
    from recallgrid.sources import memory

    sf = "/root/testdata/sf0.1"
    asked = memory.table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = {(r.query_id, r.slot_id) for r in vector.recall_batch(memory.memories(spark, sf), asked, 10).collect()}
    assert len(want) == 10 * asked.count()
    for query in (ledger.v9_recall_pq, ledger.h10_quantised_text, ledger.v3_recall_cells):
        got = {(r.query_id, r.slot_id) for r in query(spark, sf).collect()}
        print("recall@10", len(got & want) / len(want), "of", asked.count())
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "revenue grew"), (2, "warranty terms and warranty claims"), (3, "maintenance plan"), (4, "")], "id long, text string")
    assert [r.id for r in lexical.bm25(docs, "warranty WARRANTY", 5).collect()] == [2]
    assert lexical.bm25(docs, "  ", 5).count() == 0
    same = spark.createDataFrame([(i, "one two") for i in range(20)], "id long, text string")
    assert [r.id for r in lexical.bm25(same, "two", 5).collect()] == [0, 1, 2, 3, 4]
    words = spark.createDataFrame([("Größe: 94% Effizienz, Ladesäule–Nr.7",)], "t string").select(T.tokens(F.col("t"))).first()[0]
    assert {"größe", "94", "effizienz", "ladesäule", "7"} <= set(words)


def test_traverse_and_as_of(spark):
    m = memories(spark, [(str(i), [1.0], 1, 0, 0, 0, i == 3, False) for i in range(6)])
    e = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (0, 4, 3), (2, 3, 1), (3, 5, 1), (2, 0, 1)], "src long, dst long, edge_type int")
    seed = spark.createDataFrame([(0,)], "slot_id long")
    got = lambda t, h: {r.slot_id: r.depth for r in graph.traverse(e, m, seed, t, h).collect()}
    assert got(1, 2) == {1: 1, 2: 2} and got(3, 1) == {4: 1} and got(None, 5) == {1: 1, 2: 2, 4: 1}
    v = spark.createDataFrame([(1, 1, 10, 100), (1, 2, 11, 200), (1, 3, 12, 300)], "chain_id long, version int, slot_id long, created_at_ns long")
    at = lambda t: graph.as_of(v, t).first().slot_id
    assert [at(50), at(150), at(250), at(350)] == [-1, 10, 11, 12]


def test_write_log(spark):
    ops = spark.createDataFrame([(1, 7, "insert", "a"), (2, 7, "rewrite", "b"), (3, 8, "insert", "c"), (4, 8, "delete", None), (5, 8, "delete", None)], "op_seq long, slot_id long, op string, text string")
    assert sorted(tuple(r)[:3] for r in oplog.fold(ops).collect()) == [(7, "b", False), (8, "c", True)]


def test_chain_tampering(spark):
    log = spark.createDataFrame([("o", i, "save", i * 3, f"t{i}") for i in range(6)], "org_id string, seq long, event string, slot_id long, at string")
    chain = integrity.build(log)
    assert integrity.verify(chain).first().broken_at is None
    broken = lambda df: integrity.verify(df).first().broken_at
    edit = lambda c, to: chain.withColumn(c, F.when(F.col("seq") == 2, F.lit(to)).otherwise(F.col(c)))
    assert [broken(edit(c, to)) for c, to in (("slot_id", 99), ("event", "delete"), ("at", "now"), ("hash", "0"))] == [2] * 4
    assert broken(chain.where("seq <> 3")) == 4 and broken(chain.where("seq > 0")) == 1
    swapped = chain.withColumn("seq", F.when(F.col("seq") == 1, 2).when(F.col("seq") == 2, 1).otherwise(F.col("seq")))
    assert broken(swapped) == 1
    point = chain.where("seq = 4").select("org_id", "seq", "hash")
    whole, cut = (integrity.verify(x, point).first() for x in (chain, chain.where("seq < 4")))
    assert (whole.attested, whole.since, whole.chain_valid) == (True, 1, True) and (cut.attested, cut.since, cut.chain_valid) == (False, 0, True)


def test_lookups_and_writes(spark):
    m = memories(spark, [(str(i), [1.0], 1, 0, 0, 0, i == 1, False) for i in range(6)])
    slots = lambda *ids: spark.createDataFrame([(i,) for i in ids], "slot_id long")
    assert [(r.slot_id, r.state) for r in oplog.looked_up(m, slots(0, 1, 9)).orderBy("slot_id").collect()] == [(0, "live"), (1, "tombstoned"), (9, "no such slot")]
    assert oplog.got(m, slots(0)).first().text == "0"
    for dead in (1, 9):
        with pytest.raises(PySparkException):
            oplog.got(m, slots(dead)).collect()
    first = oplog.page(m, 0, 3).collect()
    assert [r.slot_id for r in first] == [0, 2, 3] and first[0].next_slot == 4 and oplog.page(m, 4, 3).first().next_slot == 4294967295
    calls = spark.createDataFrame([("a", [1.0, 2.0], None), ("b", [3.0, 4.0], 2)], "text string, vector array<float>, layer int")
    assert [(r.layer, r.created_at_ns) for r in oplog.inserted(calls, 2, 5).collect()] == [(0, 5), (2, 5)]
    with pytest.raises(PySparkException):
        oplog.inserted(calls, 3, 5).collect()
    ops = spark.createDataFrame([(1, "insert", "a", '{"id":"a"}'), (2, "update", "a", '{"id":"a","n":2}'), (3, "insert", "b", '{"id":"b"}'), (4, "remove", "b", None)], "op_seq long, op string, id string, rec string")
    assert [(r.id, r.slot_id) for r in oplog.backend(ops).collect()] == [("a", 2)]


def test_postings_equal_the_scan(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 30))))) for i in range(200)], "id long, text string")
    index = lexical.Postings(spark, str(tmp_path / "index"), buckets=4).write(docs)
    for q in ("a b", "c", "h h g zz", "zz", "  "):
        want, got = ([(r.id, round(r.score, 9)) for r in x.collect()] for x in (lexical.bm25(docs, q, 20), index.search(q, 20)))
        assert got == want


def test_sql_functions(spark):
    from recallgrid.functions.register import register

    assert "chunk_words" in register(spark)
    assert spark.sql("select cosine_sim(array(1d, 0d), array(1d, 1d)), tokenize('Große, 5!'), slug(' A b!'), slug('!'), whole_days(timestamp '2024-01-01', timestamp '2024-01-03 01:00:00')").first()[1:] == (["große", "5"], "a-b", "default", 2)
    assert [tuple(r) for r in spark.sql("select * from chunk_words('a b c', 2)").collect()] == [(0, "a b"), (1, "c")]


def test_stream_states_and_snapshot(spark, tmp_path):
    schema = "entity long, seq long, state string"
    for n, rows in enumerate([[(1, 1, "new"), (1, 2, "run"), (2, 1, "new")], [(1, 3, "new"), (1, 4, "done"), (2, 1, "run"), (2, 2, "run")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        out = index.states(stream, [("new", "run"), ("run", "done")]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
        out.awaitTermination()
    got = {(r.entity, r.seq, r.state): r.legal for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1, "new"): True, (1, 2, "run"): True, (2, 1, "new"): True, (1, 3, "new"): False, (1, 4, "done"): True, (2, 1, "run"): False, (2, 2, "run"): True}
    events = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    assert {r.entity: r.state for r in index.latest(events).collect()} == {1: "done", 2: "run"}
    rows, cursor = index.since(events.where("entity = 1"), 1, 2)
    assert [r.seq for r in rows.collect()] == [2, 3] and cursor == 3


def test_text_functions(spark):
    row = spark.createDataFrame([("w " * 2000 + "end", "")], "t string, e string")
    assert [len(x.split()) for x in row.select(T.chunks(F.col("t"))).first()[0]] == [900, 900, 201]
    short = spark.createDataFrame([("w " * 900 + "tail",)], "t string").select(T.chunks(F.col("t"))).first()[0]
    assert len(short) == 1 and short[0].endswith("w tail")
    paths = spark.createDataFrame([("src/a.py",), ("src/x/b.py",), ("../a.py",), ("src/secret/k.py",)], "p string")
    assert [r[0] for r in paths.select(T.allowed(F.col("p"), ["src/**"], ["**/secret/**"])).collect()] == [True, True, False, False]


def test_readers(spark, tmp_path):
    (tmp_path / "a.MD").write_text("hello")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.bin").write_bytes(b"x")
    assert [r.text for r in M.text_files(spark, str(tmp_path)).collect()] == ["hello"]
    assert [tuple(r) for r in M.skipped_files(spark, str(tmp_path)).collect()] == [("bin", 1)]
    np.arange(6, dtype="<f4").tofile(tmp_path / "sub/m.f32")
    assert [r.vector for r in M.f32_matrix(spark, str(tmp_path / "sub/m.f32"), 3).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]
    (tmp_path / "sub/r.rec").write_bytes(b"".join(struct.pack("<I", len(x)) + x for x in (b"one", b"", b"two")))
    assert [r.text for r in M.records(spark, str(tmp_path / "sub/r.rec")).orderBy("row").collect()] == ["one", "", "two"]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in M.jsonl(spark, str(tmp_path / "l.jsonl"), "a long").collect()) == [1, 2]


def test_stream_keeps_the_index(spark, tmp_path):
    schema = "op_seq long, slot_id long, op string, text string"
    spark.createDataFrame([(1, 7, "insert", "a"), (2, 8, "insert", "b")], schema).write.parquet(str(tmp_path / "ops"))
    q = index.maintain(index.op_stream(spark, str(tmp_path / "ops"), schema), str(tmp_path / "index"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "index"))
    assert got.count() == 2
    assert index.lag(spark.read.parquet(str(tmp_path / "ops")), got).first().lag == 0
    assert sorted((r.slot_id, r.text) for r in index.snapshot(spark, str(tmp_path / "index")).collect()) == [(7, "a"), (8, "b")]


def test_records(spark):
    from recallgrid.operators import structured

    texts = ['{"id":"a","title":"t","content":"c","tags":["x","y"],"is_latest":false}', '{"id":5,"content":"n"}', '{"content":"no id"}', '{"id":"b"', "plain", '{"id":"d","content":"only"}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "slot_id long, text string")
    got = {r.slot_id: (r.memory_id, r.display, r.is_latest) for r in structured.unwrap(df).collect()}
    assert got[0] == ("a", "t\nc", False) and got[5] == ("d", "only", True)
    assert [got[i][0] for i in (1, 2, 3, 4, 6)] == [None] * 5 and got[4][1] == "plain"
    tags = spark.createDataFrame([([" a", "a", "", "b "] + [str(i) for i in range(9)],)], "t array<string>").select(structured.normalised_tags(F.col("t"))).first()[0]
    assert tags == ["a", "b", "0", "1", "2", "3", "4", "5"]


def test_context_pack_skips_and_fails(spark):
    from recallgrid.operators import structured

    schema = "pack_id long, ordinal long, item_id long, size long, mandatory boolean"
    items = spark.createDataFrame([(1, 1, 10, 60, True), (1, 2, 11, 50, False), (1, 3, 12, 30, False)], schema)
    assert [(r.item_id, r.used) for r in structured.context_pack(items, 100).collect()] == [(10, 60), (12, 90)]
    with pytest.raises(Exception, match="over the budget"):
        structured.context_pack(items, 50).collect()
