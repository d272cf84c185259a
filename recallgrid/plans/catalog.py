"""Queries by name, with the SQL that gives the same rows."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import filters, graph, lexical, oplog, structured, vector
from ..sources import memory as M

QUERIES: dict = {}
SQL: dict = {}

_MEM = """mem as (select 'org' || (vec_id % 3) as org_id, vec_id as slot_id, 'memory ' || vec_id || ' topic ' || label as text, embedding as vector,
  (vec_id * 7919) % 256 as entity_bitmap, cast(vec_id % 4 as int) as layer, vec_id * 1000 as created_at_ns, (vec_id * 37) % 1000 * 1000 as valid_from_ns,
  vec_id % 11 = 0 as tombstoned, vec_id % 7 = 0 as superseded, label from embeddings)"""
_CUR = _MEM + ", cur as (select * from mem where not tombstoned and not superseded), q as (select embedding::double[] as qv from embeddings where vec_id = 0)"
_EDGES = """edges as (select vec_id as src, case when seq = 0 then vec_id // 2 else vec_id // 3 + 1 end as dst, cast(vec_id % 6 + 1 as int) as edge_type,
  cast((vec_id * 31) % 256 as int) as weight, cast(seq as int) as seq from embeddings, (values (0), (1)) s(seq))"""
_OPS = """ops as (select event_id as op_seq, user_id as slot_id, case event_type when 'error' then 'delete' when 'click' then 'rewrite' else 'insert' end as op, 'v' || event_id as text from events)"""
_COS = "list_cosine_similarity(vector::double[], qv)"
_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _query_vector(spark, d, vec_id: int = 0) -> list[float]:
    got = M.table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in got[0]]


def _scored(df):
    return df.select("slot_id", F.round("score", 5).alias("score"))


# Scans


@query(f"with {_MEM} select slot_id, text, superseded from mem where not tombstoned")
def sc1_live_scan(spark, d):
    return M.memories(spark, d).where(filters.live()).select("slot_id", "text", "superseded")


@query(f"with {_MEM} select slot_id, text from mem where slot_id < 400 and not tombstoned and not superseded and text <> ''")
def sc3_committed_scan(spark, d):
    return M.memories(spark, d).where(filters.current() & (F.col("slot_id") < 400) & (F.col("text") != "")).select("slot_id", "text")


@query(f"with {_MEM} select count(*) filter (not tombstoned) as live_count, count(*) as slot_count from mem")
def sc7_counts(spark, d):
    return M.memories(spark, d).agg(F.count_if(~F.col("tombstoned")).alias("live_count"), F.count("*").alias("slot_count"))


@query(f"""with {_MEM}, {_EDGES} select a.text as source, b.text as target, case e.edge_type when 2 then 'Updates' when 3 then 'Derives' when 4 then 'Contradicts' when 5 then 'PartOf' when 6 then 'Extends' else 'Mentions' end as kind, round(e.weight / 255.0, 5) as confidence
from edges e join mem a on a.slot_id = e.src join mem b on b.slot_id = e.dst""")
def sc17_relationships(spark, d):
    m = M.memories(spark, d).select("slot_id", "text")
    names = F.create_map(*(F.lit(x) for kv in {1: "Mentions", 2: "Updates", 3: "Derives", 4: "Contradicts", 5: "PartOf", 6: "Extends"}.items() for x in kv))
    e = M.edges(spark, d)
    out = e.join(m.select(F.col("slot_id").alias("src"), F.col("text").alias("source")), "src").join(m.select(F.col("slot_id").alias("dst"), F.col("text").alias("target")), "dst")
    return out.select("source", "target", F.coalesce(names[F.col("edge_type")], F.lit("Mentions")).alias("kind"), F.round(F.col("weight") / 255.0, 5).alias("confidence"))


# Writes, folded


_FOLD = f"with {_OPS}, state as (select slot_id, max_by(text, op_seq) filter (op <> 'delete') as text, bool_or(op = 'delete') as tombstoned, count(*) as n_ops, max(op_seq) as last_seq from ops group by slot_id)"


@query(f"{_FOLD} select * from state")
def w5_fold_writes(spark, d):
    return oplog.fold(M.ops(spark, d))


@query(f"{_FOLD} select count(*) filter (not tombstoned) as kept, coalesce(sum(strlen(text)) filter (not tombstoned), 0)::bigint as kept_bytes, coalesce(sum(strlen(text)) filter (tombstoned), 0)::bigint as reclaimed from state")
def sk3_compact(spark, d):
    return oplog.compacted(oplog.fold(M.ops(spark, d)))


@query(f"with {_MEM}, {_EDGES} select slot_id, exists(select 1 from edges e where e.dst = slot_id and edge_type = 2) as updated from mem")
def w4_updated(spark, d):
    hit = M.edges(spark, d).where("edge_type = 2").select(F.col("dst").alias("slot_id"), F.lit(True).alias("u")).distinct()
    return M.memories(spark, d).select("slot_id").join(hit, "slot_id", "left").select("slot_id", F.coalesce("u", F.lit(False)).alias("updated"))


# Filters and projections


@query(f"with {_MEM} select slot_id, layer from mem where layer = 2")
def f1_layer(spark, d):
    return M.memories(spark, d).where(filters.where(layer=2)).select("slot_id", "layer")


@query(f"with {_MEM} select slot_id, entity_bitmap from mem where (entity_bitmap & 18) <> 0")
def f2_entity_mask(spark, d):
    return M.memories(spark, d).where(filters.where(entity_mask=18)).select("slot_id", "entity_bitmap")


@query(f"with {_MEM} select slot_id from mem where created_at_ns between 50000 and 300000")
def f3_created_range(spark, d):
    return M.memories(spark, d).where(filters.where(created=(50000, 300000))).select("slot_id")


@query(f"with {_MEM} select slot_id from mem where valid_from_ns between 100000 and 500000")
def f4_valid_range(spark, d):
    return M.memories(spark, d).where(filters.where(valid=(100000, 500000))).select("slot_id")


@query(f"with {_MEM} select slot_id from mem where layer = 1 and (entity_bitmap & 255) <> 0 and created_at_ns between 0 and 400000 and valid_from_ns between 0 and 800000 and not tombstoned and not superseded")
def f5_all_filters(spark, d):
    return M.memories(spark, d).where(filters.current() & filters.where(1, 255, (0, 400000), (0, 800000))).select("slot_id")


@query("select doc_id, text ilike '%license%' as licensed from documents")
def f11_like(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.coalesce(F.col("text").ilike("%license%"), F.lit(False)).alias("licensed"))


@query("select page_id, regexp_matches(url, '^https?://[^/]*/en/[^/]*$') and not regexp_matches(url, 'page=') as allowed from pages")
def f12_globs(spark, d):
    path = F.regexp_extract("url", r"^https?://[^/]*/(.*)$", 1)
    return M.table(spark, d, "pages").select("page_id", T.allowed(path, ["en/*"], ["**page=**"]).alias("allowed"))


@query("select doc_id, regexp_matches(lower(text), 'api_key|password=|private key|authorization: bearer') as secret from documents")
def f14_secrets(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.lower("text").rlike(r"api_key|password=|private key|authorization: bearer").alias("secret"))


@query("select event_id, ts < timestamp '2024-01-15 00:00:00' as expired from events")
def f15_expiry(spark, d):
    return M.table(spark, d, "events").select("event_id", (F.col("ts") < F.lit("2024-02-14 00:00:00").cast("timestamp") - F.expr("interval 30 days")).alias("expired"))


@query("select c_custkey, regexp_matches(c_name, '^[A-Za-z0-9_-]{1,64}$') as ok from customer")
def f16_org_id(spark, d):
    return M.table(spark, d, "customer").select("c_custkey", T.org_id_ok(F.col("c_name")).alias("ok"))


@query("select conv_id, turn, substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 160) as snippet from conversations")
def p4_snippet(spark, d):
    return M.table(spark, d, "conversations").select("conv_id", "turn", T.snippet(F.col("text")).alias("snippet"))


# Vector recall


def _top(where="", k=10, n=5):
    return f"with {_CUR} select slot_id, round({_COS}, {n}) as score from cur, q {where} order by {_COS} desc, slot_id limit {k}"


@query(_top())
def v1_recall_brute(spark, d):
    return _scored(vector.recall(M.memories(spark, d), _query_vector(spark, d), 10))


@query(_top("where (entity_bitmap & 18) <> 0 and layer = 1"))
def v1_recall_filtered(spark, d):
    return _scored(vector.recall(M.memories(spark, d), _query_vector(spark, d), 10, filters.where(layer=1, entity_mask=18)))


@query(_top("where layer = 3", 5))
def v14_recall_layer(spark, d):
    return _scored(vector.recall(M.memories(spark, d), _query_vector(spark, d), 5, filters.where(layer=3)))


@query(f"with {_CUR} select slot_id, round(list_dot_product(vector::double[], qv), 5) as score from cur, q order by list_dot_product(vector::double[], qv) desc, slot_id limit 10")
def v13_exact_dot(spark, d):
    return _scored(vector.recall(M.memories(spark, d), _query_vector(spark, d), 10, score=V.dot))


@query(f"""with {_CUR}, ask as (select vec_id as query_id, embedding::double[] as qv from embeddings where vec_id % 10 = 0),
s as (select query_id, slot_id, list_cosine_similarity(vector::double[], ask.qv) as c from cur, ask), r as (select *, row_number() over (partition by query_id order by c desc, slot_id) as rank from s)
select query_id, slot_id, round(c, 5) as score, cast(rank as int) as rank from r where rank <= 10""")
def v17_batch_recall(spark, d):
    asked = M.table(spark, d, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.recall_batch(M.memories(spark, d), asked, 10).select("query_id", "slot_id", F.round("score", 5).alias("score"), "rank")


_I8 = "list_transform({}::double[], lambda x: cast(greatest(least(round(x * 127), 127), -127) as bigint))"


@query(f"with {_CUR} select slot_id, cast(list_sum(list_transform(list_zip({_I8.format('vector')}, {_I8.format('qv')}), lambda x: x[1] * x[2])) as bigint) as score from cur, q order by score desc, slot_id limit 10")
def v12_int8_scan(spark, d):
    return vector.int8_recall(M.memories(spark, d), _query_vector(spark, d), 10)


@query(f"with {_MEM} select slot_id, array_to_string({_I8.format('vector')}, ',') as code from mem")
def v11_int8_codes(spark, d):
    return M.memories(spark, d).select("slot_id", F.array_join(V.int8(V.doubles(F.col("vector"))).cast("array<string>"), ",").alias("code"))


@query()
def v10_drift(spark, d):
    m = M.memories(spark, d)
    return vector.ProductQuantizer().train(m).drifted(m)


# Lexical and hybrid


@query(f"select w as term, count(*) as df from (select unnest(list_distinct({_TOK})) as w from documents) group by w")
def l2_document_frequency(spark, d):
    docs = M.table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("df"))


@query(f"select doc_id, len({_TOK}) as dl from documents")
def l1_tokens(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("dl"))


@query(f"""with {_CUR}, a as (select text, row_number() over (order by {_COS} desc, slot_id) as rn from cur, q), b as (select text, row_number() over (order by slot_id % 13 desc, slot_id) as rn from cur),
u as (select text, rn, 0 as lane from a where rn <= 128 union all select text, rn, 1 from b where rn <= 128), f as (select text as key, sum(1.0::double / (60 + rn)) as score, min(lane * 1000 + rn) as first from u group by text)
select key, round(score, 6) as score from f order by f.score desc, first limit 20""")
def h1_rrf(spark, d):
    m = M.memories(spark, d).where(filters.current())
    a = vector.recall(M.memories(spark, d), _query_vector(spark, d), 128).join(m.select("slot_id", "text"), "slot_id")
    b = m.select("slot_id", "text", (F.col("slot_id") % 13).alias("r")).orderBy(F.desc("r"), "slot_id").limit(128)
    lanes = [lexical.ranked(a, "text", F.desc("score"), "slot_id"), lexical.ranked(b, "text", F.desc("r"), "slot_id")]
    return lexical.rrf(lanes).limit(20).select("key", F.round("score", 6).alias("score"))


@query()
def h6_mmr(spark, d):
    m = M.memories(spark, d)
    asked = M.table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return lexical.mmr(vector.recall_batch(m, asked, 30).join(m.select("slot_id", "vector"), "slot_id"), 10)


# Graph


@query(f"with {_EDGES} select src, dst, edge_type, weight, seq from edges where src = 25")
def g1_slot_edges(spark, d):
    return M.edges(spark, d).where("src = 25").orderBy("seq").select("src", "dst", "edge_type", "weight", "seq")


_WALK = """with recursive {mem}, {edges}, alive as (select e.* from edges e join mem m on m.slot_id = e.dst where not tombstoned{only}),
walk(t, slot, depth) as (select distinct edge_type, 100::bigint, 0 from alive union select a.edge_type, a.dst, w.depth + 1 from walk w join alive a on a.src = w.slot and a.edge_type = w.t where w.depth < 3)
select slot as slot_id, min(depth) as depth from walk where depth > 0 and slot <> 100 group by slot"""


@query(_WALK.format(mem=_MEM, edges=_EDGES, only=" and edge_type = 5"))
def g2_traverse_typed(spark, d):
    seeds = M.memories(spark, d).where("slot_id = 100").select("slot_id")
    return graph.traverse(M.edges(spark, d), M.memories(spark, d), seeds, 5, 3)


@query(_WALK.format(mem=_MEM, edges=_EDGES, only=""))
def g3_traverse_all(spark, d):
    seeds = M.memories(spark, d).where("slot_id = 100").select("slot_id")
    return graph.traverse(M.edges(spark, d), M.memories(spark, d), seeds, None, 3)


@query("""with v as (select vec_id % 50 as chain_id, vec_id // 50 as version, vec_id as slot_id, vec_id * 1000 as created_at_ns from embeddings)
select chain_id, coalesce(max_by(slot_id, version) filter (created_at_ns <= 120000), -1) as slot_id from v group by chain_id""")
def g5_as_of(spark, d):
    m = M.memories(spark, d)
    return graph.as_of(m.select((F.col("slot_id") % 50).alias("chain_id"), F.floor(F.col("slot_id") / 50).alias("version"), "slot_id", "created_at_ns"), 120000)


@query("select vec_id % 50 as chain_id, string_agg(cast(vec_id as varchar), '>' order by vec_id) as history from embeddings group by 1")
def g6_history(spark, d):
    m = M.memories(spark, d)
    return m.groupBy((F.col("slot_id") % 50).alias("chain_id")).agg(F.array_join(F.array_sort(F.collect_list("slot_id")).cast("array<string>"), ">").alias("history"))


@query(f"with {_EDGES} select src, dst, greatest(1, least(255, cast(round(coalesce(weight / 255.0, 1) * 255) as int))) as weight from edges")
def g17_weights(spark, d):
    w = F.greatest(F.lit(1), F.least(F.lit(255), F.round(F.coalesce(F.col("weight") / 255.0, F.lit(1.0)) * 255).cast("int")))
    return M.edges(spark, d).select("src", "dst", w.alias("weight"))


# Joins


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'MACHINERY'")
def j1_equi(spark, d):
    c = M.table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name")
    return M.table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def j4_semi(spark, d):
    o = M.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return M.table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("""with a as (select user_id, event_id, ts from events where event_type = 'error'), b as (select user_id, event_id as last_click, ts from events where event_type = 'click')
select a.event_id, a.user_id, max_by(b.last_click, struct_pack(t := b.ts, i := b.last_click)) as last_click from a left join b on a.user_id = b.user_id and b.ts <= a.ts group by a.event_id, a.user_id""")
def j8_as_of(spark, d):
    """As-of join by one union and a running last value, without a range join."""
    e = M.table(spark, d, "events").where("event_type in ('click', 'error')")
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("last_click", F.last(click, ignorenulls=True).over(w)).where("event_type = 'error'").select("event_id", "user_id", "last_click")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def j10_anti(spark, d):
    o = M.table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return M.table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


# Aggregates


@query("""select user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 as duration_ms, count(*) as n_events, count(*) filter (event_type = 'error') as failures, count(*) filter (event_type = 'click') as actions from events group by user_id""")
def a3_replay_metrics(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return M.table(spark, d, "events").groupBy("user_id").agg(F.floor((us(F.max("ts")) - us(F.min("ts"))) / 1000).alias("duration_ms"), F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("failures"), F.count_if(F.col("event_type") == "click").alias("actions"))


@query("select user_id, max_by(event_type, event_id) as status from events group by user_id")
def a8_status(spark, d):
    return M.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.99), 6) as p99, round(avg(value), 6) as mean from events group by event_type")
def a11_percentiles(spark, d):
    return M.table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.99), 6).alias("p99"), F.round(F.avg("value"), 6).alias("mean"))


@query("select event_type, list_sort(list(value))[least(count(*), cast(floor(0.9 * count(*)) as bigint) + 1)] as p90 from events group by event_type")
def a12_floor_percentile(spark, d):
    w = Window.partitionBy("event_type")
    e = M.table(spark, d, "events").withColumn("rn", F.row_number().over(w.orderBy("value"))).withColumn("n", F.count("*").over(w))
    return e.where(F.col("rn") == F.least(F.col("n"), F.floor(F.lit(0.9) * F.col("n")) + 1)).select("event_type", F.col("value").alias("p90"))


@query("select split_part(split_part(url, '/', 3), '.', -1) as ext, count(*) as n from pages group by 1")
def a15_histogram(spark, d):
    return M.table(spark, d, "pages").groupBy(F.element_at(F.split(F.element_at(F.split("url", "/"), 3), r"\."), -1).alias("ext")).agg(F.count("*").alias("n"))


@query(f"with {_MEM} select org_id, layer, count(*) as n from mem group by rollup (org_id, layer)")
def a17_rollup(spark, d):
    return M.memories(spark, d).rollup("org_id", "layer").agg(F.count("*").alias("n"))


# Windows, order, sets


@query("select event_id, lag(event_id) over (partition by user_id order by event_id) as prev from events")
def n2_lag(spark, d):
    return M.table(spark, d, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("prev"))


@query("with c as (select user_id, max(event_id) filter (event_type = 'click') as at from events group by user_id) select e.event_id from events e join c on e.user_id = c.user_id where e.event_id > coalesce(c.at, -1)")
def n6_after_checkpoint(spark, d):
    at = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(Window.partitionBy("user_id"))
    return M.table(spark, d, "events").withColumn("at", at).where(F.col("event_id") > F.coalesce("at", F.lit(-1))).select("event_id")


@query(f"with {_MEM} select slot_id, valid_from_ns from mem where not tombstoned order by valid_from_ns desc, slot_id limit 20")
def o3_newest(spark, d):
    return M.memories(spark, d).where(filters.live()).orderBy(F.desc("valid_from_ns"), "slot_id").limit(20).select("slot_id", "valid_from_ns")


@query(f"with {_MEM} select slot_id from mem order by slot_id limit 10 offset 20")
def o4_paging(spark, d):
    return M.memories(spark, d).orderBy("slot_id").offset(20).limit(10).select("slot_id")


@query("select user_id from events where event_type = 'click' intersect select user_id from events where event_type = 'error'")
def e2_intersect(spark, d):
    e = M.table(spark, d, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))


@query("select text, min(doc_id) as doc_id from documents group by text")
def e4_dedupe_text(spark, d):
    return M.table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


# Integrity


@query("select conv_id, string_agg('[' || (turn + 1) || '] ' || text, chr(10) || chr(10) order by turn) as prompt from (select distinct * from conversations) group by conv_id")
def x20_grounded_prompt(spark, d):
    t = M.table(spark, d, "conversations").distinct()
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), (r["turn"] + 1).cast("string"), F.lit("] "), r["text"])), "\n\n").alias("prompt"))


@query("select event_type, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2")
def st6_windows(spark, d):
    e = M.table(spark, d, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast(e.schema["ts"].dataType).alias("hour"), "n")


# Structured records


_REC = """rec as (select vec_id as slot_id, case when vec_id % 7 <> 0 then 'm' || vec_id end as memory_id,
  case when vec_id % 7 = 0 then 'note ' || vec_id when vec_id % 4 = 0 then 'body ' || vec_id else 'title ' || vec_id || chr(10) || 'body ' || vec_id end as display,
  case when vec_id % 7 = 0 then []::varchar[] else ['topic:' || label, 'mod:' || (vec_id % 3)] end as tags, not (vec_id % 5 = 0 and vec_id % 7 <> 0) as is_latest from embeddings)"""


def _records(spark, d):
    return structured.unwrap(M.structured(spark, d))


@query(f"with {_REC} select slot_id, memory_id, display, array_to_string(tags, ',') as tags, is_latest from rec")
def p2_unwrap(spark, d):
    return _records(spark, d).select("slot_id", "memory_id", "display", F.array_join("tags", ",").alias("tags"), "is_latest")


@query(f"with {_REC} select slot_id from rec where is_latest")
def f7_is_latest(spark, d):
    return _records(spark, d).where("is_latest").select("slot_id")


@query(f"with {_REC} select slot_id from rec where list_has_any(tags, ['topic:1', 'topic:2'])")
def f8_tags_any(spark, d):
    return structured.tagged(_records(spark, d), any_of=["topic:1", "topic:2"]).select("slot_id")


@query(f"with {_REC} select slot_id from rec where list_has_all(tags, ['topic:1', 'mod:2'])")
def f9_tags_all(spark, d):
    return structured.tagged(_records(spark, d), all_of=["topic:1", "mod:2"]).select("slot_id")


@query(f"with {_REC} select count(*) filter (memory_id is not null) as records, count(*) filter (memory_id is null) as prose from rec")
def f10_records(spark, d):
    r = structured.record(F.col("text"))
    return M.structured(spark, d).agg(F.count_if(r.isNotNull()).alias("records"), F.count_if(r.isNull()).alias("prose"))
