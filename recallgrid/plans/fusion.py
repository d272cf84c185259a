"""Queries of fused recall, recall along edges, and vector side operators."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import filters, hybrid, lexical, vector
from ..sources import memory as M
from .catalog import _COS, _CUR, _EDGES, _MEM, _TOK, _query_vector, _scored, query

_ASK = "topic 3 memory 41"


def _words(rows: str, terms: list[str], wide: int) -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""t as (select slot_id, is_latest, text, {_TOK} as toks from {rows}), n as (select count(*) as n, greatest(avg(len(toks)), 1) as avgdl from t),
p as (select slot_id, len(toks) as dl, w.term, len(list_filter(toks, lambda x: x = w.term)) as tf from t, (values {values}) w(term)), df as (select term, count(*) filter (tf > 0) as df from p group by term),
s as (select slot_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from p join df using (term), n where tf > 0 group by slot_id),
top as (select slot_id, score from s where score > 0 order by round(score, 9) desc, slot_id limit {wide}),
lane as (select slot_id, text, score, row_number() over (order by round(score, 9) desc, slot_id) as rn from top join t using (slot_id) where is_latest)"""


def _live(spark, d):
    return M.memories(spark, d).where(filters.live()).select("slot_id", "text", (~F.col("superseded")).alias("is_latest"))


def _near(spark, d, k):
    m = M.memories(spark, d)
    return F.broadcast(vector.recall(m, _query_vector(spark, d), k)).join(m.select("slot_id", "text"), "slot_id")


@query(f"""with {_CUR}, live as (select slot_id, text, not superseded as is_latest from mem where not tombstoned), {_words("live", _ASK.split(), 160)},
near as (select text, row_number() over (order by {_COS} desc, slot_id) as rn from cur, q qualify rn <= 160),
u as (select text, rn, 0 as lane_no from near union all select text, rn, 1 from lane), f as (select text, sum(1.0::double / (60 + rn)) as score, min(lane_no * 1000 + rn) as first from u group by text)
select text, round(score, 6) as score, 'hybrid' as mode from f order by f.score desc, first limit 10""")
def h2_hybrid(spark, d):
    return hybrid.hybrid(_live(spark, d), _ASK, 10, _near(spark, d, 160)).withColumn("score", F.round("score", 6))


@query(f"""with {_MEM}, live as (select slot_id, text, not superseded as is_latest from mem where not tombstoned), {_words("live", _ASK.split(), 160)}
select text, round(score, 6) as score, 'lexical' as mode from lane where rn <= 10""")
def h2_lexical_only(spark, d):
    return hybrid.hybrid(_live(spark, d), _ASK, 10).withColumn("score", F.round("score", 6))


_JSON = """js as (select vec_id as slot_id, label, case when vec_id % 7 = 0 then 'note ' || vec_id else '{"id":"m' || vec_id || '","title":"' || case when vec_id % 4 = 0 then '' else 'title ' || vec_id end || '","content":"body ' || vec_id
  || '","tags":["topic:' || label || '","mod:' || (vec_id % 3) || '"]' || case when vec_id % 5 = 0 then ',"is_latest":false' else '' end || '}' end as text, not (vec_id % 5 = 0 and vec_id % 7 <> 0) as is_latest from embeddings)"""


def _tagged_sql(terms, deep, k, cond):
    return f"""with {_JSON}, {_words("js", terms, max(16 * deep, 128))}, deep as (select * from lane where rn <= {deep})
select slot_id, round(score, 6) as score from deep join (select slot_id, label from js where text like '{{%') using (slot_id) where {cond} order by rn limit {k}"""


@query(_tagged_sql(["topic", "3"], 30, 5, "label = 3 and slot_id % 3 = 1"))
def h3_recall_by_tags(spark, d):
    got = hybrid.recall_by_tags(M.structured(spark, d), "topic 3", 5, any_of=["topic:3"], all_of=["mod:1"])
    return got.select("slot_id", F.round("score", 6).alias("score"))


@query(_tagged_sql(["mod", "2", "body"], 30, 5, "label in (1, 2, 3) and slot_id % 3 = 2"))
def h8_coverage_recall(spark, d):
    got = hybrid.recall_by_tags(M.structured(spark, d), "mod 2 body", 5, ["topic:1", "topic:2", "topic:3"], ["mod:2"])
    return got.select("slot_id", F.round("score", 6).alias("score"))


_CAND = f"""with {_CUR}, c as (select slot_id, text, row_number() over (order by {_COS} desc, slot_id) as rank from cur, q qualify rank <= 30),
o as (select *, len(list_intersect(list_distinct({_TOK}), ['topic', '3', 'memory', '41'])) / 4.0::double as overlap from c)"""


def _overlap(text):
    q = F.array(*map(F.lit, _ASK.split()))
    return F.size(F.array_intersect(q, F.array_distinct(T.tokens(text)))) / F.lit(4.0)


def _candidates(spark, d):
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "slot_id"))  # 30 rows
    return _near(spark, d, 30).select("slot_id", "text", rank.alias("rank"))


@query(f"{_CAND} select slot_id, round(overlap, 6) as score from o order by overlap desc, rank limit 10")
def h4_rerank(spark, d):
    return hybrid.rerank(_candidates(spark, d), 10, _overlap).select("slot_id", F.round("rescored", 6).alias("score"))


@query(f"""{_CAND}, r as (select slot_id, rank - 1 as a, row_number() over (order by overlap desc, rank) - 1 as b from o)
select slot_id, round(1.0::double / (60 + a) + 1.0::double / (60 + b), 6) as score from r order by 1.0::double / (60 + a) + 1.0::double / (60 + b) desc, a limit 10""")
def h5_rrf_from_zero(spark, d):
    c = _candidates(spark, d).withColumn("overlap", _overlap(F.col("text")))
    b = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("overlap"), "rank")) - 1
    fused = 1.0 / (59 + F.col("rank")) + 1.0 / (60 + F.col("b"))
    return c.withColumn("b", b).select("slot_id", "rank", fused.alias("f")).orderBy(F.desc("f"), "rank").limit(10).select("slot_id", F.round("f", 6).alias("score"))


@query(f"""with recursive {_CUR}, {_EDGES}, seed as (select slot_id from cur, q order by {_COS} desc, slot_id limit 20),
walk(slot_id, depth) as (select slot_id, 0 from seed union select e.dst, w.depth + 1 from walk w join edges e on e.src = w.slot_id where w.depth < 2)
select slot_id, round({_COS}, 5) as score from cur, q where slot_id in (select slot_id from walk) order by {_COS} desc, slot_id limit 10""")
def v15_recall_with_hops(spark, d):
    return _scored(hybrid.recall_with_hops(M.memories(spark, d), M.edges(spark, d), _query_vector(spark, d), 10, 2))


@query("""with p as (select vec_id as slot_id, c::int as copy, embedding::double[] as v, list_transform(embedding::double[], lambda x, i: x + ((vec_id * 31 + i * 17 + c * 101) % 2001 - 1000) / 1000.0::double * 0.05::double) as w from embeddings, range(0, 3) r(c))
select slot_id, copy, round(list_cosine_similarity(v, w), 5) as near from p""")
def v18_perturbed(spark, d):
    m = M.memories(spark, d)
    return hybrid.perturbed(m, 3).join(m.select("slot_id", F.col("vector").cast("array<double>").alias("v")), "slot_id").select("slot_id", "copy", F.round(V.cosine(F.col("vector"), F.col("v")), 5).alias("near"))


@query("select coalesce(text, '') as text, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) > 1")
def e4_repeated_texts(spark, d):
    docs = M.table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    return docs.groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(f"""with live as (select doc_id as slot_id, true as is_latest, text from documents where doc_id % 4 <> 0 and text <> ''), {_words("live", ["the", "of"], 20)}
select slot_id as doc_id, round(score, 6) as score from lane""")
def l5_read_only_recall(spark, d):
    """Outdated and empty rows go before the statistics here."""
    docs = M.table(spark, d, "documents").where("doc_id % 4 <> 0 and text <> ''").select(F.col("doc_id").alias("id"), "text")
    return lexical.bm25(docs, "the of", 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("select conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: len(x) >= 3))), ' ') as terms from conversations")
def l7_query_terms(spark, d):
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9_]+"), F.lit(0)), lambda x: F.char_length(x) >= 3)
    return M.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("terms"))
