"""Queries of lookups, writes, audit chains, skills and tasks, history recall, the code graph's slices and stored indexes."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import register as R
from ..functions import text as T
from ..functions import vectors as V
from ..operators import codegraph, hybrid, integrity, lexical, oplog, structured, vector, workflow
from ..sources import memory as M
from ..sources import shared
from .catalog import _CUR, _EDGES, _I8, _MEM, _TOK, query
from .fusion import _JSON, _words
from .workflow import _graph, _t


def _asked(spark, d, every=50):
    return M.table(spark, d, "embeddings").where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


# Scans and lookups


@query(f"with {_MEM}, p as (select slot_id, text from mem where not tombstoned and slot_id >= 100 order by slot_id limit 50) select slot_id, text, (select max(slot_id) + 1 from p) as next_slot from p")
def sc2_page(spark, d):
    return oplog.page(M.memories(spark, d), 100, 50).select("slot_id", "text", "next_slot")


@query(f"with {_MEM} select slot_id, 4294967295 as next_slot from mem where not tombstoned and slot_id >= (select max(slot_id) - 20 from mem)")
def sc2_last_page(spark, d):
    m = M.memories(spark, d)
    return oplog.page(m, m.agg(F.max("slot_id")).first()[0] - 20, 50).select("slot_id", "next_slot")


_SLOTS = "asked as (select c_custkey - 10 as slot_id from customer where c_custkey < 100 union all select 1000000000)"


@query(f"with {_MEM}, {_SLOTS} select a.slot_id, case when m.slot_id is null then 'no such slot' when tombstoned then 'tombstoned' else 'live' end as state, case when not tombstoned then text end as text from asked a left join mem m using (slot_id)")
def sc4_point_get(spark, d):
    asked = M.table(spark, d, "customer").where("c_custkey < 100").selectExpr("c_custkey - 10 as slot_id").unionByName(spark.range(1).selectExpr("1000000000 as slot_id"))
    return oplog.looked_up(M.memories(spark, d), asked)


_ID_ROWS = f"""{_JSON}, rows_ as (select slot_id, case when text like '{{%' then 'm' || slot_id end as id, slot_id % 13 = 0 as tombstoned, slot_id % 7 = 1 as superseded from js
union all select slot_id + 100000, case when text like '{{%' then 'm' || slot_id end, false, false from js where slot_id % 3 = 0)"""


@query(f"with {_ID_ROWS}, ids as (select 'm' || c_custkey as id from customer where c_custkey < 150), best as (select id, slot_id from rows_ where id is not null and not tombstoned qualify row_number() over (partition by id order by superseded, slot_id) = 1) select id, coalesce(slot_id, -1) as slot_id from ids left join best using (id)")
def sc5_find_by_id(spark, d):
    s = M.structured(spark, d)
    rows = s.selectExpr("slot_id", "text", "slot_id % 13 = 0 as tombstoned", "slot_id % 7 = 1 as superseded").unionByName(s.where("slot_id % 3 = 0").selectExpr("slot_id + 100000 as slot_id", "text", "false as tombstoned", "false as superseded"))
    return oplog.found_by_id(rows, M.table(spark, d, "customer").where("c_custkey < 150").selectExpr("concat('m', c_custkey) as id"))


@query("""with l as (select event_id as op_seq, case event_type when 'error' then 'remove' when 'click' then 'update' else 'insert' end as op, 'r' || user_id as id from events),
t as (select *, lead(op) over (partition by id order by op_seq) as then_op from l) select id, op_seq as slot_id from t where op <> 'remove' and coalesce(then_op, 'insert') = 'insert'""")
def sc16_record_backend(spark, d):
    ops = _t(spark, d, "events", "event_id as op_seq", "case event_type when 'error' then 'remove' when 'click' then 'update' else 'insert' end as op", "concat('r', user_id) as id", "concat('{\"id\":\"r', user_id, '\",\"n\":', event_id, '}') as rec")
    return oplog.backend(ops).select("id", "slot_id")


# Writes


@query("select vec_id as slot_id, case when vec_id % 3 = 0 then vec_id % 4 else 0 end::int as layer, case when vec_id % 2 = 0 then vec_id * 10 else 777 end as created_at_ns, 0::bigint as valid_from_ns, false as tombstoned from embeddings")
def w1_insert(spark, d):
    """Inserts with and without a layer and a time of their own (W1, W2)."""
    calls = _t(spark, d, "embeddings", "vec_id as slot_id", "embedding as vector", "concat('t', vec_id) as text", "if(vec_id % 3 = 0, cast(vec_id % 4 as int), null) as layer", "if(vec_id % 2 = 0, vec_id * 10, null) as created_at_ns")
    return oplog.inserted(calls, 64, 777).select("slot_id", "layer", "created_at_ns", "valid_from_ns", "tombstoned")


@query(f"""with {_EDGES}, more as (select user_id as src, event_id as dst, row_number() over (partition by user_id order by event_id) as n from events where event_type = 'click')
select src, dst, seq::bigint as seq from edges union all select m.src, m.dst, coalesce((select max(seq) from edges e where e.src = m.src), -1) + n from more m""")
def w7_add_edge(spark, d):
    new = M.table(spark, d, "events").where("event_type = 'click'").selectExpr("user_id as src", "event_id as dst", "1 as edge_type", "255 as weight", "event_id as op_seq")
    return oplog.edges_added(M.edges(spark, d), new).select("src", "dst", F.col("seq").cast("long").alias("seq"))


@query("select user_id as src, (event_id % 4)::int as i, max_by(event_id // 3, event_id) as dst, max_by((event_id % 6 + 1)::int, event_id) as edge_type from events group by 1, 2")
def w8_set_edge(spark, d):
    ops = _t(spark, d, "events", "event_id as op_seq", "user_id as src", "cast(event_id % 4 as int) as i", "event_id div 3 as dst", "cast(event_id % 6 + 1 as int) as edge_type", "255 as weight")
    return oplog.edges_set(ops).select("src", "i", "dst", "edge_type")


# Projections, vectors, words


@query("""select o_custkey as task_id, string_agg(o_orderkey || '/' || o_orderstatus, ',' order by o_orderkey) as receipts from orders group by 1""")
def p3_redacted(spark, d):
    """Nested receipts without what they prove or quote; the objective goes too."""
    o = M.table(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.struct(F.col("o_orderkey").alias("receipt"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("excerpt"), F.col("o_totalprice").alias("artifacts")).alias("r"))
    tasks = o.groupBy("task_id").agg(F.array_sort(F.collect_list("r")).alias("receipts"), F.lit("objective").alias("objective"))
    slim = workflow.redacted(tasks, ["objective", "excerpt", "artifacts", "criterion_id", "attestation", "path"])
    shown = F.transform("receipts", lambda r: F.concat_ws("/", *(r[f.name].cast("string") for f in slim.schema["receipts"].dataType.elementType.fields)))
    return slim.select(*(c for c in slim.columns if c != "receipts"), F.array_join(shown, ",").alias("receipts"))


@query(f"with {_MEM}, v as (select slot_id, case when slot_id = 3 then list_transform(vector::double[], lambda x: 0) else vector::double[] end as v from mem), n as (select slot_id, v, sqrt(list_dot_product(v, v)) as l from v) select slot_id, array_to_string(list_transform(v, lambda x: (round(x / case when l = 0 then 1 else l end * 10000))::int), ',') as unit from n")
def v16_normalised(spark, d):
    v = F.when(F.col("slot_id") == 3, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector"))
    unit = F.transform(V.normalise(V.doubles(v)), lambda x: F.round(x * 10000).cast("int").cast("string"))
    return M.memories(spark, d).select("slot_id", F.array_join(unit, ",").alias("unit"))


@query("""with w as (select conv_id, turn, list_transform(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''),
  lambda w: list_reduce(list_transform(string_split(w, ''), lambda c: unicode(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint) % 64) as b from conversations),
c as (select conv_id, turn, list_transform(range(0, 64), lambda i: len(list_filter(b, lambda x: x = i))::double) as c from w), n as (select *, sqrt(list_dot_product(c, c)) as l from c)
select conv_id, turn, array_to_string(list_transform(c, lambda x: (round(x / case when l = 0 then 1 else l end * 100000))::int), ',') as unit from n""")
def v19_word_hash_vectors(spark, d):
    unit = F.transform(hybrid.word_vector(F.col("text")), lambda x: F.round(x * 100000).cast("int").cast("string"))
    return M.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(unit, ",").alias("unit"))


@query(f"select doc_id, round(len(list_intersect(list_filter(list_distinct({_TOK}), lambda x: length(x) >= 2), ['the', 'of', 'and', 'que'])) / 4.0, 4) as overlap from documents")
def l6_overlap(spark, d):
    """Of the query's words of two characters or more; 'a' doesn't count."""
    long = lambda t: F.filter(F.array_distinct(t), lambda x: F.char_length(x) >= 2)
    q = long(F.array(*map(F.lit, ("the", "of", "and", "que", "a"))))
    return M.table(spark, d, "documents").select("doc_id", F.round(F.size(F.array_intersect(q, long(T.tokens(F.col("text"))))) / F.size(q), 4).alias("overlap"))


_CHUNKED = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')"


@query(f"""with w as (select doc_id, {_CHUNKED} as w from documents), p as (select doc_id, list_transform(range(0, greatest(((len(w) + 99) // 100), 1)), lambda i: array_to_string(w[i * 100 + 1 : i * 100 + 100], ' ')) as p from w),
m as (select doc_id, case when len(p) > 1 and length(p[-1]) <= 20 then list_append(p[1 : len(p) - 2], p[-2] || ' ' || p[-1]) else p end as p from p)
select doc_id, len(p) as n, sha256(array_to_string(p, '|')) as digest from m""")
def text_chunks(spark, d):
    c = T.chunks(F.coalesce("text", F.lit("")), 100)
    return M.table(spark, d, "documents").select("doc_id", F.size(c).cast("long").alias("n"), F.sha2(F.array_join(c, "|"), 256).alias("digest"))


@query("""with c as (select doc_id, list_filter(list_transform(range(0, greatest(length(coalesce(text, '')) - 1, 0) + 1, 1300), lambda i: substr(coalesce(text, ''), i + 1, 1500)), lambda x: length(trim(x)) >= 60) as c from documents)
select doc_id, len(c) as n, sha256(array_to_string(c, '|')) as digest from c""")
def text_char_chunks(spark, d):
    c = T.char_chunks(F.coalesce("text", F.lit("")))
    return M.table(spark, d, "documents").select("doc_id", F.size(c).cast("long").alias("n"), F.sha2(F.array_join(c, "|"), 256).alias("digest"))


@query("""select vec_id as slot_id, round(list_cosine_similarity(embedding::double[], [x / 10.0::double for x in range(0, 64)]), 6) as sim, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm,
(vec_id % 1024 >> 8) & 3 as layer, (vec_id & 32) <> 0 as flag, 'team-' || vec_id as slug from embeddings""")
def sql_functions(spark, d):
    """The expressions as SQL functions, after register()."""
    R.register(spark)
    return M.table(spark, d, "embeddings").selectExpr("vec_id as slot_id", "round(cosine_sim(cast(embedding as array<double>), transform(sequence(0, 63), x -> x / 10d)), 6) as sim", "round(l2_norm(cast(embedding as array<double>)), 6) as norm", "slot_layer(cast(vec_id % 1024 as int)) as layer", "slot_flag(cast(vec_id as int), 32) as flag", "slug(concat('--Team! ', vec_id, ' ')) as slug")


# Stored indexes


@query(f"""with t as (select doc_id, {_TOK} as toks from documents), n as (select count(*) as n, greatest(avg(len(toks)), 1) as avgdl from t),
p as (select doc_id, len(toks) as dl, w.term, len(list_filter(toks, lambda x: x = w.term)) as tf from t, (values ('the'), ('of'), ('and')) w(term)), df as (select term, count(*) filter (tf > 0) as df from p group by term),
s as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from p join df using (term), n where tf > 0 group by doc_id)
select doc_id, round(score, 6) as score from s where score > 0 order by s.score desc, doc_id limit 20""")
def l4_bm25(spark, d):
    """Over postings that are written at the first query of a table and read by the later ones."""
    docs = lambda: M.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    index = shared.held(spark, ("postings", d), lambda: lexical.Postings(spark, shared.folder(spark, "postings")).write(docs()))
    return index.search("the of and", 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def _coded(spark, d):
    """The quantizer trained on a table and its written codes, made once an application."""

    def make():
        m = M.memories(spark, d)
        pq, path = vector.ProductQuantizer().train(m), shared.folder(spark, "codes")
        pq.encode_rows(m).write.parquet(path)
        return pq, path

    pq, path = shared.held(spark, ("codes", d), make)
    return pq, spark.read.schema("slot_id long, code array<smallint>, aligned double").parquet(path)


@query()
def v6_pq_codes(spark, d):
    return _coded(spark, d)[1].select("slot_id", "code", F.round("aligned", 5).alias("aligned"))


@query()
def v7_decoded(spark, d):
    pq, codes = _coded(spark, d)
    return codes.select("slot_id", F.array_join(F.transform(pq.decode(F.col("code")), lambda x: F.round(x, 4).cast("string")), ",").alias("vector"))


@query()
def v9_recall_pq(spark, d):
    pq, codes = _coded(spark, d)
    return pq.recall_batch(M.memories(spark, d), _asked(spark, d), 10, codes).select("query_id", "slot_id", F.round("score", 5).alias("score"), "rank")


@query()
def h10_quantised_text(spark, d):
    """The quantised path skips fusion; an untrained quantizer raises."""
    pq, codes = _coded(spark, d)
    m = M.memories(spark, d)
    return pq.recall_batch(m, _asked(spark, d), 10, codes).join(m.select("slot_id", "text"), "slot_id").select("query_id", "slot_id", "text", F.round("score", 5).alias("score"))


@query()
def v3_recall_cells(spark, d):
    """Every id divisible by 50 asks; the memories lie in a folder for each cell."""
    m = M.memories(spark, d)
    index = shared.held(spark, ("cells", d), lambda: hybrid.CellIndex().fit(m).write(m, shared.folder(spark, "cells")))
    return index.recall_batch(m, _asked(spark, d), 10).select("query_id", "slot_id", F.round("score", 5).alias("score"), "rank")


_EXACT = f"""{_CUR}, ask as (select vec_id as query_id, embedding::double[] as qv from embeddings where vec_id % 50 = 0),
exact as (select query_id, slot_id, row_number() over (partition by query_id order by list_cosine_similarity(vector::double[], ask.qv) desc, slot_id) as rn from cur, ask qualify rn <= 10)"""


@query(f"with {_EXACT} select true as enough, count(distinct query_id) as queries from exact")
def v9_recall_at_10(spark, d):
    """Whether the quantised recall holds 0.9 of the ten nearest, over all ids divisible by 50."""
    pq, codes = _coded(spark, d)
    return _recall_at(spark, d, pq.recall_batch(M.memories(spark, d), _asked(spark, d), 10, codes))


@query(f"with {_EXACT} select true as enough, count(distinct query_id) as queries from exact")
def v3_recall_at_10(spark, d):
    return _recall_at(spark, d, v3_recall_cells(spark, d))


def _recall_at(spark, d, found):
    want = vector.recall_batch(M.memories(spark, d), _asked(spark, d), 10).select("query_id", "slot_id")
    hit = found.select("query_id", "slot_id", F.lit(1).alias("hit"))
    return want.join(hit, ["query_id", "slot_id"], "left").agg((F.count("hit") >= 0.9 * F.count("*")).alias("enough"), F.count_distinct("query_id").alias("queries"))


@query(f"""with {_EXACT}, i8 as (select query_id, slot_id, row_number() over (partition by query_id order by list_sum(list_transform(list_zip({_I8.format('vector')}, {_I8.format('ask.qv')}), lambda x: x[1] * x[2])) desc, slot_id) as rn from cur, ask qualify rn <= 10),
a as (select query_id, list(slot_id) as x, min_by(slot_id, rn) as x1 from exact group by 1), b as (select query_id, list(slot_id) as y, min_by(slot_id, rn) as y1 from i8 group by 1)
select round(len(list_intersect(x, y)) / 10.0, 4) as overlap, count(*) as queries, round(avg((x1 = y1)::int), 6) as top1 from a join b using (query_id) group by 1""")
def a10_overlap(spark, d):
    """Exact recall against the 8-bit scan: how many queries share how much, and agree on the first."""
    m, q = M.memories(spark, d), _asked(spark, d)
    return vector.overlap_report(vector.recall_batch(m, q, 10), vector.int8_recall_batch(m, q, 10), 10)


# History recall by tags


_KIND = "case vec_id % 6 when 0 then 'decision' when 1 then 'refactor' when 2 then 'bug' when 3 then 'fix' when 4 then 'gotcha' else 'other' end"
_NOTES = f"""notes as (select vec_id as slot_id, {_KIND} as kind, vec_id % 5 as file, true as is_latest, '{{"id":"n' || vec_id || '","title":"note ' || {_KIND} || '","content":"file f' || (vec_id % 5) || ' item ' || vec_id || '","tags":["' || {_KIND} || '","file:f' || (vec_id % 5) || '"' || case when vec_id % 9 = 0 then ',"decision"' else '' end || ']}}' as text from embeddings)"""


@query(f"with {_NOTES}, {_words('notes', ['f1', 'file'], 480)}, deep as (select * from lane where rn <= 30) select slot_id, round(score, 6) as score from deep join notes using (slot_id) where kind in ('bug', 'fix', 'gotcha') and file = 1 order by rn limit 5")
def h7_recall_bugs(spark, d):
    got = hybrid.recall_by_tags(M.notes(spark, d), "file f1", 5, ["bug", "fix", "gotcha"], ["file:f1"])
    return got.select("slot_id", F.round("score", 6).alias("score"))


@query(f"""with {_NOTES}, {_words('notes', ['f2', 'file'], 768)}, deep as (select * from lane where rn <= 48), hit as (select slot_id, kind, rn from deep join notes using (slot_id) where file = 2 order by rn limit 8)
select case when kind = 'decision' or slot_id % 9 = 0 then 'decisions' when kind = 'refactor' then 'refactors' when kind in ('bug', 'fix', 'gotcha') then 'bugs' else 'other' end as bucket, string_agg(slot_id, ',' order by rn) as slots from hit group by 1""")
def h9_why_code(spark, d):
    found = hybrid.recall_by_tags(M.notes(spark, d), "file f2", 8, [], ["file:f2"])
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "slot_id"))  # 8 rows
    return hybrid.why_code(found.withColumn("rank", rank)).select("bucket", F.array_join(F.col("slots").cast("array<string>"), ",").alias("slots"))


# Graph


@query(f"with {_MEM}, {_EDGES} select slot_id, (select count(*) from edges where src = slot_id) as n from mem")
def g7_degree(spark, d):
    """A memory's own edges."""
    n = M.edges(spark, d).groupBy(F.col("src").alias("slot_id")).agg(F.count("*").alias("n"))
    return M.memories(spark, d).select("slot_id").join(n, "slot_id", "left").select("slot_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("select (select count(*) from nation) + 2 * (select count(*) from supplier) as nodes, (select count(*) from nation) + 3 * (select count(*) from supplier) as edges, (select count(*) from nation) + (select count(*) from supplier) as files, 'python' as languages")
def g13_status(spark, d):
    links, nodes = _graph(spark, d)
    return codegraph.status(nodes, links)


_NODES = """nodes as (select 'helper_' || n_nationkey as name, 'n' || n_nationkey || '.py::helper_' || n_nationkey as qualified_name, 'n' || n_nationkey || '.py' as file_path, 4 as line from nation
union all select 'C', 's' || s_suppkey || '.py::C', 's' || s_suppkey || '.py', 4 from supplier union all select 'run', 's' || s_suppkey || '.py::C.run', 's' || s_suppkey || '.py', 5 from supplier),
terms as (select * from (values (0, 'helper_1'), (1, 'run'), (2, 's1')) t(term_at, term)),
hit as (select *, row_number() over (partition by term_at order by file_path, line, qualified_name) as rn from nodes, terms where contains(lower(name), term) or contains(lower(qualified_name), term) qualify rn <= 8),
sl as (select row_number() over (order by min((term_at, rn)), qualified_name) as place, qualified_name, file_path, line from hit group by qualified_name, file_path, line qualify place <= 16)"""


@query(f"with {_NODES} select place, qualified_name from sl")
def g14_slice_nodes(spark, d):
    links, nodes = _graph(spark, d)
    return codegraph.graph_slice(nodes, links, "Run helper_1 at s1")[0].select(F.col("place").cast("long").alias("place"), "qualified_name")


@query(f"""with {_NODES}, c as (select 's' || s_suppkey || '.py' as f, 'n' || s_nationkey || '.py::helper_' || s_nationkey as target from supplier),
links as (select 'CALLS' as kind, f || '::C.run' as source, target, f as file_path, 6 as line from c union all select 'CALLS', f || '::<module>', target, f, 9 from c
union all select 'IMPORTS', f, 'pkg', f, 1 from c union all select 'IMPORTS', 'n' || n_nationkey || '.py', 'os', 'n' || n_nationkey || '.py', 1 from nation),
near as (select l.*, place, row_number() over (partition by place order by l.file_path, l.line, kind, source, target) as rn from links l join sl on (sl.qualified_name = l.source or sl.qualified_name = l.target) where place <= 8 qualify rn <= 8)
select kind, source, target, file_path, line from near group by all order by min((place, rn)) limit 24""")
def g14_slice_edges(spark, d):
    links, nodes = _graph(spark, d)
    return codegraph.graph_slice(nodes, links, "Run helper_1 at s1")[1]


# Sets and counts


@query("select user_id, event_id from events where event_type = 'click' union select user_id, event_id + 1 from events where event_type = 'error'")
def e1_union(spark, d):
    e = M.table(spark, d, "events")
    return e.where("event_type = 'click'").select("user_id", "event_id").union(e.where("event_type = 'error'").selectExpr("user_id", "event_id + 1")).distinct()


@query(f"""with {_MEM}, {_EDGES}, r as (select org_id, count(*) as relationships from edges join mem on src = slot_id where not tombstoned group by 1)
select org_id, count(*) filter (not tombstoned) as live, count(*) filter (not tombstoned and layer = 0) as memories, count(*) filter (not tombstoned and layer = 0 and not superseded) as latest,
greatest(0, count(*) filter (not tombstoned) - count(*) filter (not tombstoned and layer = 0)) as other, any_value(relationships) as relationships from mem join r using (org_id) group by org_id""")
def a1_org_stats(spark, d):
    live, memo = ~F.col("tombstoned"), ~F.col("tombstoned") & (F.col("layer") == 0)
    m = M.memories(spark, d)
    own = M.edges(spark, d).groupBy(F.col("src").alias("slot_id")).agg(F.count("*").alias("edges"))
    rows = m.join(own, "slot_id", "left")
    return rows.groupBy("org_id").agg(F.count_if(live).alias("live"), F.count_if(memo).alias("memories"), F.count_if(memo & ~F.col("superseded")).alias("latest"), F.greatest(F.lit(0), F.count_if(live) - F.count_if(memo)).alias("other"), F.sum(F.when(live, F.col("edges"))).alias("relationships"))


# Integrity


_CHAIN = """a as (select 'org' || (user_id % 10) as org_id, event_id as seq, user_id as slot_id, event_type as event, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as stamp, row_number() over (partition by user_id % 10 order by event_id) as n, count(*) over (partition by user_id % 10) as size from events),
chain as (select *, repeat('0', 64) as prev_hash, sha256(repeat('0', 64) || '|' || seq || '|' || event || '|' || slot_id || '|' || stamp) as hash from a where n = 1
union all select a.*, c.hash, sha256(c.hash || '|' || a.seq || '|' || a.event || '|' || a.slot_id || '|' || a.stamp) from chain c join a on a.org_id = c.org_id and a.n = c.n + 1)"""


@query(f"with recursive {_CHAIN} select org_id, seq, prev_hash, hash from chain")
def x1_build_chain(spark, d):
    return integrity.build(M.audit(spark, d)).select("org_id", "seq", "prev_hash", "hash")


@query(f"""with recursive {_CHAIN}, told as (select org_id, case when org_id = 'org3' and n = 10 then lead(seq) over w when org_id = 'org3' and n = 11 then lag(seq) over w else seq end as seq, slot_id,
case when org_id = 'org1' and n = 20 then 'edited' else event end as event, case when org_id = 'org5' and n = 7 then 'later' else stamp end as stamp, prev_hash, hash, n, size from chain window w as (partition by org_id order by n)),
kept as (select * from told where not (org_id = 'org2' and n = 30) and not (org_id = 'org4' and n > size - 5)),
bad as (select *, hash <> sha256(prev_hash || '|' || seq || '|' || event || '|' || slot_id || '|' || stamp) or prev_hash <> coalesce(lag(hash) over (partition by org_id order by seq), repeat('0', 64)) as bad from kept),
cp as (select org_id, max(seq) as cs, max_by(hash, seq) as ch from chain where n <= size - 2 and org_id <> 'org9' group by 1)
select org_id, count(*) as entries, count(*) filter (bad) = 0 as chain_valid, min(seq) filter (bad) as broken_at, any_value(cs) as checkpoint_seq, bool_or(seq = cs and hash = ch) as attested, case when any_value(cs) is not null then count(*) filter (seq > cs) end as since
from bad left join cp using (org_id) group by org_id""")
def x2_verify_chain(spark, d):
    """Chains with an edited, a dropped, a swapped and a re-dated entry, and a cut tail that only the checkpoint shows."""
    chain = integrity.build(M.audit(spark, d))
    w = Window.partitionBy("org_id").orderBy("seq")
    n = chain.withColumn("n", F.row_number().over(w)).withColumn("size", F.count("*").over(Window.partitionBy("org_id")))
    points = n.where((F.col("n") <= F.col("size") - 2) & (F.col("org_id") != "org9")).groupBy("org_id").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
    org, at = F.col("org_id"), F.col("n")
    seq = F.when((org == "org3") & (at == 10), F.lead("seq").over(w)).when((org == "org3") & (at == 11), F.lag("seq").over(w)).otherwise(F.col("seq"))
    told = n.withColumns({"seq": seq, "event": F.when((org == "org1") & (at == 20), "edited").otherwise(F.col("event")), "at": F.when((org == "org5") & (at == 7), "later").otherwise(F.col("at"))})
    return integrity.verify(told.where(~((org == "org2") & (at == 30)) & ~((org == "org4") & (at > F.col("size") - 5))), points)


@query("""with l as (select user_id as log_id, event_id, row_number() over (partition by user_id order by event_id) as sequence from events),
k as (select *, sequence <> coalesce(lag(sequence) over (partition by log_id order by sequence) + 1, 1) as gap from l where event_id % 97 <> 0),
h as (select log_id, max(sequence) as top from l group by 1), g as (select log_id, max(sequence) as own from k group by 1)
select log_id, sequence, unnest(list_filter([case when event_id % 89 = 0 then 'json' end, case when event_id % 83 = 0 then 'repo' end, case when gap then 'sequence' end, case when gap then 'previous' end,
case when event_id % 89 = 0 or event_id % 83 = 0 or event_id % 79 = 0 or event_id % 73 = 0 then 'hash' end], lambda x: x is not null)) as issue from k
union all select log_id, coalesce(own, 0), 'head' from h left join g using (log_id) where own is distinct from top""")
def x3_chain_issues(spark, d):
    """A chain whose rows were dropped, edited in payload, type or task, and moved between repositories."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = M.table(spark, d, "events").select(F.col("user_id").alias("log_id"), n.cast("long").alias("sequence"), F.lit("repo").alias("repo_id"), "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("task_id"), F.col("props").alias("payload"))
    log = workflow.chained(e).withColumn("event_id", F.substring("task_id", 2, 20).cast("long"))
    heads = log.groupBy("log_id").agg(F.max_by("event_hash", "sequence").alias("head"))
    edit = lambda c, by, to: F.when(F.col("event_id") % by == 0, to).otherwise(F.col(c))
    bad = log.where("event_id % 97 <> 0").withColumns({"payload": edit("payload", 89, "{broken"), "repo_id": edit("repo_id", 83, "other"), "event_type": edit("event_type", 79, "forged"), "task_id": edit("task_id", 73, "t-1")})
    return workflow.chain_issues(bad, "repo", heads).select(F.col("log_id").cast("long").alias("log_id"), "sequence", "issue")


#: The legal steps of a task, a parameter of the check.
STEPS = [("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("signup", "error"), ("view", "error"), ("click", "error"), ("purchase", "error")]


@query(f"""with legal(was, state) as (values {", ".join(f"('{a}', '{b}')" for a, b in STEPS)}), t as (select user_id as entity, event_id as seq, event_type as state, lag(event_type) over (partition by user_id order by event_id) as was from events)
select entity, seq, was, state from t anti join legal using (was, state) where was is not null""")
def x4_illegal_steps(spark, d):
    e = _t(spark, d, "events", "user_id as entity", "event_id as seq", "event_type as state")
    return integrity.illegal_steps(e, STEPS).select("entity", "seq", "was", "state")


# Tasks and skills


@query("""with s as (select p_partkey as skill_id, p_size % 3 = 0 as high, case when p_partkey % 2 = 0 then 'owner' end as approval, p_size % 5 as sources from part),
r as (select l_partkey as skill_id, count(distinct l_orderkey % 4) filter (l_returnflag <> 'R') as passed, count(distinct l_orderkey % 4) filter (l_returnflag <> 'R' and l_linestatus = 'F') as better from lineitem where l_linenumber = 1 group by 1)
select skill_id, case when high and approval is null then 'no approval' when not high and sources < 3 then 'too few sources' when coalesce(passed, 0) < case when high then 1 else 2 end then 'too few passed replays'
when coalesce(better, 0) < case when high then 1 else 2 end then 'too few improved replays' else 'promote' end as verdict from s left join r using (skill_id)""")
def a5_promotion(spark, d):
    skills = _t(spark, d, "part", "p_partkey as skill_id", "if(p_size % 3 = 0, 'High impact', 'low') as risk", "if(p_size % 5 = 0, array(), transform(sequence(1, cast(p_size % 5 as int)), x -> concat('t', x))) as sources", "if(p_partkey % 2 = 0, 'owner', null) as approval")
    runs = M.table(spark, d, "lineitem").where("l_linenumber = 1").selectExpr("l_partkey as skill_id", "l_orderkey % 4 as replay_task_id", "if(l_returnflag = 'R', 'fail', 'pass') as status", "l_linestatus = 'F' as improved")
    return workflow.promotion(skills, runs)


@query("""with o as (select l_partkey as skill_id, count(*) filter (l_returnflag = 'R') as failures, bool_or(l_returnflag = 'R' and l_linenumber = 7) as unsafe from lineitem group by 1),
s as (select p_partkey as skill_id, p_size % 7 = 0 as wrong_schema, p_size % 3 + 1 as policy, case when p_partkey % 11 <> 0 then timestamp '2024-01-01' + to_days((p_partkey % 90)::int) end as expiry from part)
select skill_id, array_to_string(list_filter([case when wrong_schema then 'schema' end, case when policy <> 2 then 'policy' end, case when expiry is null then 'no proof expiry' when expiry + interval 30 days < timestamp '2024-03-10' then 'proof expired' end,
case when failures >= 3 then failures || ' failures' end, case when unsafe then 'safety violation' end], lambda x: x is not null), ',') as reasons from s left join o using (skill_id)""")
def a6_demotion(spark, d):
    skills = _t(spark, d, "part", "p_partkey as skill_id", "if(p_size % 7 = 0, 2, 1) as schema_version", "p_size % 3 + 1 as policy_version", "case when p_partkey % 11 <> 0 then timestampadd(day, cast(p_partkey % 90 as int), timestamp '2024-01-01') end as proof_expires_at")
    outcomes = _t(spark, d, "lineitem", "l_partkey as skill_id", "if(l_returnflag = 'R', 'fail', 'pass') as status", "if(l_linenumber = 7, array('a safety violation was seen'), array('slow')) as issues")
    return workflow.demotion(skills, outcomes, 2, "2024-03-10").select("skill_id", F.array_join("reasons", ",").alias("reasons"))


@query("""with m as (select distinct user_id from events where event_type = 'signup' and ts >= timestamp '2024-01-05'), k as (select user_id, case user_id % 5 when 0 then 'sealed' when 1 then 'blocked' when 2 then 'failed' when 3 then 'active' end as status from m)
select count(*) as managed, count(*) filter (status = 'sealed') as sealed, coalesce(string_agg(user_id, ',' order by user_id) filter (status = 'blocked'), '') as blocked, coalesce(string_agg(user_id, ',' order by user_id) filter (status = 'failed'), '') as failed, 25 as days,
array_to_string(list_filter([case when count(*) filter (status is null) > 0 then 'unreadable tasks' end, '25/30 days', case when count(*) < 100 then count(*) || '/100 tasks' end], lambda x: x is not null), ',') as blockers, false as ready from k""")
def a7_release_report(spark, d):
    events = _t(spark, d, "events", "user_id as task_id", "if(event_type = 'signup', 'task_created', event_type) as event_type", "ts")
    tasks = M.table(spark, d, "events").select(F.col("user_id").alias("task_id")).distinct().where("task_id % 5 < 4").withColumn("status", F.element_at(F.array(*map(F.lit, ("sealed", "blocked", "failed", "active"))), (F.col("task_id") % 5 + 1).cast("int")))
    row = workflow.release_report(events, tasks, "2024-01-05", "2024-01-30 12:00:00", chain_valid=True, attested=True)
    return row.select("managed", "sealed", F.array_join(F.col("blocked").cast("array<string>"), ",").alias("blocked"), F.array_join(F.col("failed").cast("array<string>"), ",").alias("failed"), F.col("days").cast("int").alias("days"), F.array_join("blockers", ",").alias("blockers"), "ready")


@query("""select o_custkey as task_id, 'failed receipt' as kind, o_orderkey::varchar as ref from orders where o_orderstatus = 'F' union all select user_id, 'open risks', event_id::varchar from events where event_id % 3 = 0""")
def a9_failures_and_risks(spark, d):
    receipts = _t(spark, d, "orders", "o_custkey as task_id", "o_orderkey as criterion_id", "if(o_orderstatus = 'F', 'fail', 'pass') as status")
    points = _t(spark, d, "events", "user_id as task_id", "event_id as sequence", "case event_id % 3 when 0 then '[\"r\"]' when 1 then '[]' end as open_risks")
    return workflow.failures_and_risks(receipts, points)


_PACK = """i as (select user_id as pack_id, event_id as item_id, 7 + event_id * 13 % 41 as size, row_number() over (partition by user_id order by event_id) as n from events),
f as (select pack_id, item_id, n, size as used, true as kept, size from i where n = 1 union all select i.pack_id, i.item_id, i.n, case when f.used + i.size <= 150 then f.used + i.size else f.used end, f.used + i.size <= 150, i.size from f join i on i.pack_id = f.pack_id and i.n = f.n + 1)"""


def _items(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return M.table(spark, d, "events").select(F.col("user_id").alias("pack_id"), F.col("event_id").alias("ordinal"), F.col("event_id").alias("item_id"), (7 + F.col("event_id") * 13 % 41).alias("size"), (n <= 2).alias("mandatory"))


@query(f"with recursive {_PACK} select pack_id, item_id, used from f where kept")
def x5_context_pack(spark, d):
    """Items of unequal sizes, the first two mandatory: one that doesn't fit is skipped, smaller later ones still enter."""
    return structured.context_pack(_items(spark, d), 150)


@query(f"with recursive {_PACK} select pack_id, round(1 - sum(size) filter (kept)::double / sum(size), 6) as reduction from f group by 1")
def a14_reduction(spark, d):
    """How much smaller the compiled packs are than all their items."""
    items = _items(spark, d)
    kept = structured.context_pack(items, 150).groupBy("pack_id").agg(F.max("used").alias("compiled"))
    return items.groupBy("pack_id").agg(F.sum("size").alias("whole")).join(kept, "pack_id").select("pack_id", F.round(1 - F.col("compiled") / F.col("whole"), 6).alias("reduction"))


@query("""with t as (select o_orderkey as task_id, o_orderpriority as task_type, case when o_custkey % 3 = 0 then 'src/**,docs/' || (o_custkey % 2) when o_custkey % 3 = 1 then 'docs/' || (o_custkey % 2) || ',src/**' else '' end as paths from orders where o_orderstatus = 'F' and o_orderkey % 40 = 0)
select task_type, paths, string_agg(task_id, ',' order by task_id) as sources, greatest(0, 3 - count(*)) as missing from t group by 1, 2""")
def x16_candidates(spark, d):
    """Paths are arrays, compared in order."""
    two = "concat('docs/', o_custkey % 2)"
    tasks = M.table(spark, d, "orders").where("o_orderkey % 40 = 0").selectExpr("o_orderkey as task_id", "o_orderpriority as task_type", "if(o_orderstatus = 'F', 'sealed', 'open') as status", f"case o_custkey % 3 when 0 then array('src/**', {two}) when 1 then array({two}, 'src/**') else array() end as allowed_paths")
    return workflow.candidates(tasks).select("task_type", F.array_join("allowed_paths", ",").alias("paths"), F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"), F.col("missing").cast("long").alias("missing"))


@query("""with c as (select user_id, max(event_id) - 3 as after from events where event_type = 'signup' group by 1), u as (select distinct user_id from events)
select e.user_id as task_id, 'event' as kind, event_id::varchar as ref, sha256(props) as digest from events e left join c using (user_id) where event_id > coalesce(after, -1)
union all select u.user_id, 'contract', 'contract', sha256('contract ' || u.user_id) from u left join c using (user_id) where after is null or u.user_id % 4 = 0
union all select u.user_id, 'decision', 'd' || i, sha256('decision ' || i) from u left join c using (user_id), range(0, 3) r(i) where after is null or i = 2 or i = 1 and u.user_id % 2 = 0
union all select u.user_id, 'skill', 's1', sha256('skill ' || (u.user_id % 7)) from u""")
def x18_context_delta(spark, d):
    """Events, the contract, decisions resolved anew and skills, against each task's latest checkpoint."""
    tasks = M.table(spark, d, "events").select(F.col("user_id").alias("task_id")).distinct()
    points = M.table(spark, d, "events").where("event_type = 'signup'").selectExpr("user_id as task_id", "event_id as sequence", "event_id - 3 as event_sequence", "sha2(concat('contract ', user_id, if(user_id % 4 = 0, ' old', '')), 256) as contract_digest", "map('d0', sha2('decision 0', 256), 'd1', sha2(if(user_id % 2 = 0, 'older', 'decision 1'), 256)) as refs")
    decisions = tasks.selectExpr("task_id", "explode(sequence(0, 2)) as i").selectExpr("task_id", "concat('d', i) as ref", "concat('decision ', i) as content")
    return workflow.context_delta(_t(spark, d, "events", "user_id as task_id", "event_id as sequence", "props as payload"), points, tasks.selectExpr("task_id", "concat('contract ', task_id) as contract"), decisions, tasks.selectExpr("task_id", "'s1' as ref", "concat('skill ', task_id % 7) as content"))
