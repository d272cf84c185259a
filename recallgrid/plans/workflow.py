"""Queries of structured saves, task logs, skills, decisions, authority and the code graph.

The adapters derive each operator's tables from the driver's by fixed rules; the SQL uses the same rules.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import codegraph, structured, workflow
from ..sources import memory as M
from .catalog import _REC, query


def _t(spark, d, name, *exprs):
    return M.table(spark, d, name).selectExpr(*exprs)


# Projections and path predicates


@query(f"with {_REC} select slot_id, display from rec where memory_id is not null")
def p1_display(spark, d):
    return structured.unwrap(M.structured(spark, d)).where("memory_id is not null").select("slot_id", "display")


@query("select page_id, page_id % 3 = 1 as overlaps from pages")
def f13_paths_overlap(spark, d):
    p = M.table(spark, d, "pages").select("page_id", F.array(F.concat(F.lit("src/"), (F.col("page_id") % 3).cast("string"), F.lit("/**"))).alias("a"))
    return p.select("page_id", workflow.paths_overlap(F.col("a"), F.array(F.lit("src/1/*.py"), F.lit("docs/?"))).alias("overlaps"))


@query("select c_custkey, regexp_matches(case when c_custkey % 2 = 0 then lower(replace(c_name, '#', '-')) else c_name end, '^[a-z0-9_-]{1,96}$') as ok from customer")
def f17_skill_id(spark, d):
    name = F.when(F.col("c_custkey") % 2 == 0, F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))).otherwise(F.col("c_name"))
    return M.table(spark, d, "customer").select("c_custkey", name.rlike(r"^[a-z0-9_-]{1,96}$").alias("ok"))


@query("select page_id from pages where not (regexp_matches(url, '^https?://[^/]*/en/[^/]*$') and not regexp_matches(url, 'page='))")
def x14_out_of_scope(spark, d):
    path = F.regexp_extract("url", r"^https?://[^/]*/(.*)$", 1)
    return M.table(spark, d, "pages").where(~T.allowed(path, ["en/*"], ["**page=**"])).select("page_id")


# Structured writes


_VERSIONS = """log as (select event_id as seq, case event_type when 'error' then 'delete' else 'save' end as op, user_id as memory_id from events),
v as (select seq as slot_id, memory_id, coalesce(then_op <> 'save', true) as is_latest, coalesce(then_op = 'delete', false) as tombstoned from (select *, lead(op) over (partition by memory_id order by seq) as then_op from log) where op = 'save')"""


def _saves(spark, d):
    return _t(spark, d, "events", "event_id as seq", "case event_type when 'error' then 'delete' else 'save' end as op", "user_id as memory_id")


@query(f"with {_VERSIONS} select * from v")
def w10_update_in_place(spark, d):
    return workflow.versions(_saves(spark, d))


@query(f"with {_VERSIONS} select slot_id, memory_id from v where tombstoned")
def w11_delete_by_id(spark, d):
    return workflow.versions(_saves(spark, d)).where("tombstoned").select("slot_id", "memory_id")


_RELATED = "s as (select event_id as slot_id, case event_type when 'click' then 'update' when 'view' then 'derive' when 'error' then 'unknown' end as relation, event_id // 2 as target from events)"


def _related(spark, d):
    s = _t(spark, d, "events", "event_id as slot_id", "case event_type when 'click' then 'update' when 'view' then 'derive' when 'error' then 'unknown' end as relation", "event_id div 2 as target")
    return workflow.related(s)


@query(f"with {_RELATED} select slot_id as src, target as dst, cast(case relation when 'update' then 2 else 3 end as int) as edge_type, 255 as weight from s where relation in ('update', 'derive')")
def w9_saved_relations(spark, d):
    return _related(spark, d)[0]


@query(f"with {_RELATED} select distinct target as slot_id from s where relation = 'update'")
def w9_outdated(spark, d):
    return _related(spark, d)[1]


@query(f"""with {_REC}, r as (select slot_id, unnest(tags) as tag, (slot_id * 37) % 1000 * 1000 as valid_from_ns from rec)
select tag, slot_id from r where tag like 'topic:%' qualify row_number() over (partition by tag order by valid_from_ns desc, slot_id) = 1""")
def w12_newest_of_file(spark, d):
    m = M.memories(spark, d).select("slot_id", "valid_from_ns")
    rows = structured.unwrap(M.structured(spark, d)).select("slot_id", "tags").join(m, "slot_id")
    return workflow.newest_tagged(rows, M.table(spark, d, "embeddings").select(F.concat(F.lit("topic:"), F.col("label").cast("string")).alias("tag")))


@query("""select p_partkey, 'Decision: ' || p_name || chr(10) || 'Rationale: ' || p_type || case when p_size % 3 = 0 then '' else chr(10) || 'Alternatives considered: ' || p_brand || '; none' end
|| case when p_size % 2 = 0 then '' else chr(10) || 'Affected files: f' || p_size || '.py' end as text, p_type || ',decision' || case when p_size % 2 = 0 then '' else ',file:f' || p_size || '.py' end as tags from part""")
def w13_log_decision(spark, d):
    none = F.array().cast("array<string>")
    others = F.when(F.col("p_size") % 3 == 0, none).otherwise(F.array(F.col("p_brand"), F.lit("none")))
    files = F.when(F.col("p_size") % 2 == 0, none).otherwise(F.array(F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit(".py"))))
    text, tags = workflow.decision_record(F.col("p_name"), F.col("p_type"), others, files, F.array("p_type"))
    return M.table(spark, d, "part").select("p_partkey", text.alias("text"), F.array_join(tags, ",").alias("tags"))


_FIRST = "list_filter(list_filter(regexp_split_to_array(text, ' '), lambda x: trim(x) <> ''), lambda x, i: list_position(list_filter(regexp_split_to_array(text, ' '), lambda y: trim(y) <> ''), x) = i)"


@query(f"""select conv_id, turn, substr(trim(text), 1, 160) as title, array_to_string({_FIRST}[1:8], '|') as tags, array_to_string({_FIRST}[1:12], '|') as entities,
case when role in ('fact', 'event') then role else 'fact' end as memory_type from conversations where trim(text) <> ''""")
def w14_normalised_save(spark, d):
    words = F.split("text", " ")
    calls = M.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("title"), F.col("text").alias("content"), words.alias("tags"), words.alias("entities"), F.col("role").alias("memory_type"))
    return workflow.normalised_save(calls).select("conv_id", "turn", "title", F.array_join("tags", "|").alias("tags"), F.array_join("entities", "|").alias("entities"), "memory_type")


@query("""with l as (select conv_id, turn, case role when 'user' then 'User: ' when 'tool' then '  -> ' else 'Assistant: ' end || case when length(trim(text)) > 80 then substr(trim(text), 1, 80) || '…[truncated]' else trim(text) end as line from conversations where trim(text) <> '')
select conv_id as session, right(string_agg(line, chr(10) order by turn, line), 300) as text from l group by conv_id""")
def sc12_transcript(spark, d):
    return workflow.transcript(_t(spark, d, "conversations", "conv_id as session", "turn as ordinal", "role", "text"), 80, 300)


# Logs and receipts


@query("""with m as (select user_id as task_id, ts < timestamp '2024-01-16' as base, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 as duration_ms, count(*) filter (event_type = 'error') as denials, count(*) filter (event_type = 'click') as actions from events group by 1, 2)
select r.task_id, r.denials = 0 and (r.duration_ms < b.duration_ms or r.actions < b.actions) as improved from m r join m b using (task_id) where b.base and not r.base""")
def a4_improved(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    e = M.table(spark, d, "events").withColumn("base", F.col("ts") < F.lit("2024-01-16").cast("timestamp"))
    m = e.groupBy(F.col("user_id").alias("task_id"), "base").agg(F.floor((us(F.max("ts")) - us(F.min("ts"))) / 1000).alias("duration_ms"), F.count_if(F.col("event_type") == "error").alias("denials"), F.count_if(F.col("event_type") == "click").alias("actions"))
    return workflow.improved(m.where("base"), m.where("not base"))


@query("select source, sum(strlen(coalesce(text, '')))::bigint as bytes, count(*) as n from documents group by source")
def a2_bytes_by_org(spark, d):
    return M.table(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), F.count("*").alias("n"))


@query("""with h as (select event_type, ts < timestamp '2024-01-16' as early, avg(value) as mean from events group by 1, 2)
select a.event_type, round(a.mean, 6) as early_mean, round(b.mean, 6) as late_mean, round(100 * (b.mean / a.mean - 1), 4) as growth from h a join h b using (event_type) where a.early and not b.early""")
def a13_growth(spark, d):
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    m = M.table(spark, d, "events").groupBy("event_type").agg(F.avg(F.when(early, F.col("value"))).alias("a"), F.avg(F.when(~early, F.col("value"))).alias("b"))
    return m.select("event_type", F.round("a", 6).alias("early_mean"), F.round("b", 6).alias("late_mean"), F.round(100 * (F.col("b") / F.col("a") - 1), 4).alias("growth")).where("early_mean is not null and late_mean is not null")


@query("""with last as (select o_custkey, max(o_orderkey) as k from orders group by 1), r as (select l.o_custkey as task_id, o.o_orderkey as sequence, o.o_orderstatus as st, left(o.o_orderpriority, 1) = '1' as high from last l join orders o on o.o_orderkey = l.k)
select task_id, sequence, i::int as ordinal, case i when 1 then 'r' || sequence else 'unnamed risk' end as label from r join customer on c_custkey = task_id, range(1, 3) x(i) where st <> 'O' and (high or c_mktsegment = 'MACHINERY')""")
def x15_open_risks(spark, d):
    marks = "case when o_orderstatus = 'O' then '[]' else concat('[{\"id\":\"r', o_orderkey, '\",\"severity\":\"', if(left(o_orderpriority, 1) = '1', 'High', 'low'), '\"},{\"severity\":\"low\"}]') end as open_risks"
    tasks = _t(spark, d, "customer", "c_custkey as task_id", "if(c_mktsegment = 'MACHINERY', 'Security review', 'low') as risk")
    return workflow.unresolved_risks(_t(spark, d, "orders", "o_custkey as task_id", "o_orderkey as sequence", marks), tasks)


@query("""with c as (select c_custkey % 25 as task_id, c_custkey as criterion_id, 'd' || (c_custkey % 3) as cd, 'w' || (c_custkey % 4) as ws, c_custkey % 2 = 0 as approval from customer where c_custkey % 7 <> 0),
r as (select o_custkey as criterion_id, case o_orderstatus when 'F' then 'fail' else 'pass' end as status, 'd' || case when o_orderkey % 11 = 0 then 9 else o_custkey % 3 end as rcd, 'w' || case when o_orderkey % 13 = 0 then 9 else o_custkey % 4 end as rws,
case when o_orderkey % 3 <> 0 then o_orderdate end as expires_at from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)
select task_id, criterion_id, case when status is null then 'no receipt' when status <> 'pass' then 'status' when rcd <> cd then 'contract changed' when rws <> ws then 'workspace changed'
when approval and expires_at <= timestamp '1996-01-01' then 'approval expired' when approval and expires_at is null then 'approval without expiry' end as reason from c left join r using (criterion_id)""")
def x13_seal_reasons(spark, d):
    criteria = _t(spark, d, "customer", "c_custkey % 25 as task_id", "c_custkey as criterion_id", "case when c_custkey % 7 = 0 then false when c_custkey % 5 <> 0 then true end as required", "concat('d', c_custkey % 3) as contract_digest", "concat('w', c_custkey % 4) as workspace", "c_custkey % 2 = 0 as approval")
    receipts = _t(spark, d, "orders", "o_custkey % 25 as task_id", "o_custkey as criterion_id", "o_orderkey as seq", "if(o_orderstatus = 'F', 'fail', 'pass') as status", "concat('d', if(o_orderkey % 11 = 0, 9, o_custkey % 3)) as contract_digest", "concat('w', if(o_orderkey % 13 = 0, 9, o_custkey % 4)) as workspace", "case when o_orderkey % 3 <> 0 then o_orderdate end as expires_at")
    return workflow.seal_reasons(criteria, receipts, "1996-01-01")


# Skills, decisions, authority, health


@query("""select s_suppkey as task_id, p_partkey as skill_id from supplier join part on p_brand = 'Brand#' || (s_suppkey % 25 + 1) and p_partkey % 7 = s_suppkey % 7
where p_size % 2 = 0 and p_size % 3 = 0 and (p_partkey % 4 = 0 or timestamp '2024-01-01' + to_days((p_partkey % 60)::int) > timestamp '2024-02-01')""")
def x6_matching_skills(spark, d):
    skills = _t(spark, d, "part", "p_partkey as skill_id", "if(p_size % 2 = 0, 'active', 'retired') as state", "p_size % 3 = 0 as verified", "case when p_partkey % 4 <> 0 then timestampadd(day, cast(p_partkey % 60 as int), timestamp '2024-01-01') end as expires_at", "array(p_brand, p_type) as task_types", "array(concat('src/', p_partkey % 7, '/**'), 'docs/*') as patterns")
    tasks = _t(spark, d, "supplier", "s_suppkey as task_id", "concat('Brand#', s_suppkey % 25 + 1) as task_type", "array(concat('src/', s_suppkey % 7, '/api/?.py')) as paths")
    return workflow.matching_skills(skills, tasks, "2024-02-01")


@query("""select c_custkey as ref, case when s_name is not null then 'snapshot' when p_name is not null then 'repository' when event_type is not null then 'cache' else 'unresolved' end as authority,
case when s_name is not null then 'unexpired' when p_name is not null then 'tracked' when event_type is not null then 'local' else 'unavailable' end as freshness, coalesce(s_name, p_name, event_type) as content
from customer left join (select * from supplier where s_suppkey % 2 = 0) on s_suppkey = c_custkey left join (select * from part where p_size < 10) on p_partkey = c_custkey left join (select * from events where event_id % 2 = 0) on event_id = c_custkey""")
def x7_decisions(spark, d):
    sources = [("snapshot", "unexpired", _t(spark, d, "supplier", "s_suppkey as ref", "s_name as content").where("ref % 2 = 0")), ("repository", "tracked", M.table(spark, d, "part").where("p_size < 10").selectExpr("p_partkey as ref", "p_name as content")), ("cache", "local", _t(spark, d, "events", "event_id as ref", "event_type as content").where("ref % 2 = 0"))]
    return workflow.resolved_decisions(_t(spark, d, "customer", "c_custkey as ref"), sources)


@query("""select event_id as evaluation_id, array_to_string(list_filter([case when c_custkey is null then 'unknown skill' end, case when c_custkey % 4 <> event_id % 4 then 'digest changed' end, case when event_id % 9 = event_id % 6 then 'replay of its own source' end,
case when event_type = 'error' then 'failed' end, case when value >= 100 then 'no event' end], lambda x: x is not null), ',') as issues from events left join (select * from customer where c_custkey < 100) on c_custkey = user_id""")
def x8_evaluation_issues(spark, d):
    e = _t(spark, d, "events", "event_id as evaluation_id", "user_id as skill_id", "concat('d', event_id % 4) as digest", "event_id % 9 as task_id", "event_id % 6 as source_task_id", "if(event_type = 'error', 'fail', 'pass') as status")
    skills = M.table(spark, d, "customer").where("c_custkey < 100").selectExpr("c_custkey as skill_id", "concat('d', c_custkey % 4) as digest")
    backed = M.table(spark, d, "events").where("value < 100").select(F.col("event_id").alias("evaluation_id"))
    return workflow.evaluation_issues(e, skills, backed).select("evaluation_id", F.array_join("issues", ",").alias("issues"))


@query("select user_id as task_id, bool_or(event_id % 50 = 0 or event_id % 71 = 0) as violated from events group by 1")
def x9_safety_violations(spark, d):
    text = "case when event_id % 50 = 0 then '{\"safety_violation\":true}' when event_id % 71 = 0 then '{\"safety_violations\":[\"x\"]}' when event_id % 72 = 0 then '{\"safety_violations\":[]}' else props end as input"
    return workflow.safety_violations(_t(spark, d, "events", "user_id as task_id", text))


@query("""select c_custkey as repo_id, case when c_custkey % 5 = 0 then 'scope mismatch' when c_custkey % 60 > 31 and c_custkey % 3 <> c_custkey % 4 then 'conflict' else 'accept' end as verdict,
array_to_string(list_sort(list_filter(list_distinct(['d1', 'd' || (c_custkey % 5)]), lambda x: x not in ('d1', 'd2', 'd' || (c_custkey % 6)))), ',') as absent from customer where c_custkey % 2 = 0""")
def x17_authority(spark, d):
    cached = _t(spark, d, "customer", "c_custkey as repo_id", "c_mktsegment as scope", "concat('r', c_custkey % 3) as revision", "timestampadd(day, cast(c_custkey % 60 as int), timestamp '2024-01-01') as expires_at")
    incoming = M.table(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey as repo_id", "if(c_custkey % 5 = 0, 'OTHER', c_mktsegment) as scope", "concat('r', c_custkey % 4) as revision", "array('d1', 'd2', concat('d', c_custkey % 6)) as decisions", "array('d1', concat('d', c_custkey % 5)) as refs")
    return workflow.authority_verdicts(cached, incoming, "2024-02-01").withColumn("absent", F.array_join("absent", ","))


@query("""select n_regionkey, count(*) filter (n_nationkey % 4 = 0) as issues, count(*) filter (n_nationkey % 4 = 0) = 0 as healthy from nation group by 1""")
def x19_health(spark, d):
    status = F.when(F.col("n_nationkey") % 4 == 0, "fail").when(F.col("n_nationkey") % 3 == 0, "warn").otherwise("ok")
    checks = M.table(spark, d, "nation").groupBy("n_regionkey").agg(F.count_if(status == "fail").alias("issues"))
    return checks.select("n_regionkey", "issues", (F.col("issues") == 0).alias("healthy"))


# Code graph


def _sources(spark, d):
    """Two kinds of Python files: one for each nation, one for each supplier; a region is a repository."""
    n = _t(spark, d, "nation", "n_nationkey", "n_regionkey as repo")
    own = n.selectExpr("repo", "concat('n', n_nationkey, '.py') as file_path", r"concat('import os\n\n\ndef helper_', n_nationkey, '():\n    return os.getcwd()\n') as source")
    s = _t(spark, d, "supplier", "s_suppkey", "s_nationkey as n_nationkey").join(F.broadcast(n), "n_nationkey")
    call = "concat('helper_', n_nationkey, '()')"
    using = s.selectExpr("repo", "concat('s', s_suppkey, '.py') as file_path", rf"concat('from pkg import n', n_nationkey, '\n\n\nclass C:\n    def run(self):\n        return ', {call}, '\n\n\n', {call}, '\nmissing()\n') as source")
    return own.unionByName(using)


def _graph(spark, d):
    rows = codegraph.symbols(_sources(spark, d))
    return codegraph.edges(rows), codegraph.nodes(rows)


@query("""select 'FUNCTION' as kind, 'helper_' || n_nationkey as name, 'n' || n_nationkey || '.py::helper_' || n_nationkey as qualified_name, 'n' || n_nationkey || '.py' as file_path, 4 as line from nation
union all select 'CLASS', 'C', 's' || s_suppkey || '.py::C', 's' || s_suppkey || '.py', 4 from supplier union all select 'FUNCTION', 'run', 's' || s_suppkey || '.py::C.run', 's' || s_suppkey || '.py', 5 from supplier""")
def g8_code_symbols(spark, d):
    return _graph(spark, d)[1]


@query("""with c as (select 's' || s_suppkey || '.py' as f, 'n' || s_nationkey || '.py::helper_' || s_nationkey as target from supplier)
select 'CALLS' as kind, f || '::C.run' as source, target, f as file_path, 6 as line from c union all select 'CALLS', f || '::<module>', target, f, 9 from c
union all select 'IMPORTS', f, 'pkg', f, 1 from c union all select 'IMPORTS', 'n' || n_nationkey || '.py', 'os', 'n' || n_nationkey || '.py', 1 from nation""")
def g9_code_edges(spark, d):
    return _graph(spark, d)[0]


@query("select 's' || s_suppkey || '.py::C.run' as qualified_name, 's' || s_suppkey || '.py' as file_path from supplier where s_nationkey = 3")
def g10_callers(spark, d):
    return codegraph.callers_of(*_graph(spark, d), "helper_3")


@query("select distinct 'n' || s_nationkey || '.py::helper_' || s_nationkey as qualified_name, 'n' || s_nationkey || '.py' as file_path from supplier")
def g10_callees(spark, d):
    return codegraph.callees_of(*_graph(spark, d), "C.run")


@query("select distinct 's' || s_suppkey || '.py' as source, 'pkg' as target from supplier where s_suppkey = 1")
def g11_imports(spark, d):
    return _graph(spark, d)[0].where("kind = 'IMPORTS' and source = 's1.py'").select("source", "target").distinct()


@query("select 'n' || n_nationkey || '.py::helper_' || n_nationkey as qualified_name from nation where 'helper_' || n_nationkey ilike '%helper_1%'")
def g12_find_symbol(spark, d):
    return _graph(spark, d)[1].where(F.col("name").ilike("%helper_1%")).select("qualified_name")


_CODE = """code as (select n_regionkey as repo, 'n' || n_nationkey || '.py' as f, 'import os' || chr(10) || chr(10) || chr(10) || 'def helper_' || n_nationkey || '():' || chr(10) || '    return os.getcwd()' || chr(10) as src from nation
union all select n_regionkey, 's' || s_suppkey || '.py', 'from pkg import n' || s_nationkey || chr(10) || chr(10) || chr(10) || 'class C:' || chr(10) || '    def run(self):' || chr(10) || '        return helper_' || s_nationkey || '()' || chr(10) || chr(10) || chr(10) || 'helper_' || s_nationkey || '()' || chr(10) || 'missing()' || chr(10) from supplier join nation on s_nationkey = n_nationkey),
prints as (select repo, sha256(string_agg(f || chr(0) || sha256(src) || chr(0), '' order by f)) as fingerprint from code group by repo)"""


@query(f"with {_CODE} select * from prints")
def g15_fingerprint(spark, d):
    return codegraph.fingerprint(_sources(spark, d))


@query(f"with {_CODE} select repo, repo % 2 = 0 as fresh from prints")
def g16_freshness(spark, d):
    now = codegraph.fingerprint(_sources(spark, d))
    recorded = now.withColumn("fingerprint", F.when(F.col("repo") % 2 == 0, F.col("fingerprint")).otherwise("stale"))
    return codegraph.fresh(recorded, now)
