"""Queries of row-level operators, sets and joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, oplog, vector
from ..sources import memory as M
from .catalog import _COS, _CUR, _FOLD, _MEM, _TOK, _query_vector, query


@query(f"with {_MEM} select text from mem where slot_id = 12")
def sc6_slot_text(spark, d):
    return M.memories(spark, d).where("slot_id = 12").select("text")


@query(f"with {_CUR} select 'p' || slot_id as id, round({_COS}, 5) as score, cast(label as varchar) as topic from cur, q order by {_COS} desc, slot_id limit 5")
def sc15_search_points(spark, d):
    """Points keep their id and payload as JSON in the text."""
    topic = F.regexp_extract("text", r"(\d+)$", 1)
    m = M.memories(spark, d)
    m = m.withColumn("text", F.to_json(F.struct(F.concat(F.lit("p"), F.col("slot_id").cast("string")).alias("id"), F.struct(topic.alias("topic")).alias("payload"))))
    found = F.broadcast(vector.recall(m, _query_vector(spark, d), 5)).join(m.select("slot_id", "text"), "slot_id")
    p = F.from_json("text", "id string, payload struct<topic:string>")
    return found.select(p["id"].alias("id"), F.round("score", 5).alias("score"), p["payload"]["topic"].alias("topic"))


@query(f"{_FOLD} select slot_id, last_seq from state where tombstoned")
def w6_deleted(spark, d):
    return oplog.fold(M.ops(spark, d)).where("tombstoned").select("slot_id", "last_seq")


@query(f"with {_MEM} select slot_id from mem where not tombstoned and not superseded")
def f6_current(spark, d):
    return M.memories(spark, d).where(filters.current()).select("slot_id")


@query(f"""with n as (select count(*) as n from documents), df as (select w as term, count(*) as df from (select unnest(list_distinct({_TOK})) as w from documents) group by w)
select term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from df, n""")
def l3_idf(spark, d):
    docs = M.table(spark, d, "documents")
    n = docs.agg(F.count("*").alias("n"))  # one row
    df = docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", F.round(F.log(1 + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))), 6).alias("idf"))


_LANES = """a as (select user_id, list(distinct cast(floor(value) as bigint) % 10) as x from events where event_type = 'click' group by 1), b as (select user_id, list(distinct cast(floor(value) as bigint) % 10) as y from events where event_type = 'view' group by 1)"""


@query(f"with {_LANES} select user_id, len(list_intersect(x, y)) as shared from a join b using (user_id)")
def j5_shared_results(spark, d):
    e = M.table(spark, d, "events")
    lane = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.collect_set(F.floor("value") % 10).alias(name))
    return lane("click", "x").join(lane("view", "y"), "user_id").select("user_id", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"))


@query("select c_custkey from customer except select o_custkey from orders where o_totalprice > 300000")
def e3_except(spark, d):
    return M.table(spark, d, "customer").select("c_custkey").distinct().join(M.table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def n3_last_wins(spark, d):
    last = M.table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("r"))
    return last.select("user_id", "r.*")


@query("select distinct s.s_name as source, n.n_name as target from supplier s join nation n on s_nationkey = n_nationkey where n_regionkey = 1")
def j2_inner_distinct(spark, d):
    n = M.table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target"))
    return M.table(spark, d, "supplier").join(n, "s_nationkey").select(F.col("s_name").alias("source"), "target").distinct()
