"""Task logs, receipts, skills, decisions and authority: checks over append-only tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that make a task a high risk.
RISK_WORDS = ["high", "critical", "security", "deploy", "credential", "migration", "destructive", "external"]
#: Kinds of a saved memory.
KINDS = ["fact", "preference", "decision", "goal", "event", "lesson"]


def stem(glob: Column) -> Column:
    """A path pattern up to its first wildcard."""
    return F.regexp_extract(glob, r"^[^*?\[]*", 0)


def paths_overlap(a: Column, b: Column) -> Column:
    """Arrays of patterns: some stem of one begins with some stem of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: stem(x).startswith(stem(y)) | stem(y).startswith(stem(x))))


def matching_skills(skills: DataFrame, tasks: DataFrame, now: str) -> DataFrame:
    """task_id, skill_id: active, verified, unexpired skills of the task's type whose patterns overlap its paths.

    ``skills``: skill_id, state, verified, expires_at, task_types, patterns; ``tasks``: task_id, task_type, paths.
    The join is on the type, so only skills of one type meet.
    """
    usable = skills.where((F.col("state") == "active") & F.col("verified") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))))
    typed = usable.select("skill_id", "patterns", F.explode(F.array_distinct("task_types")).alias("task_type"))
    return tasks.join(typed, "task_type").where(paths_overlap(F.col("patterns"), F.col("paths"))).select("task_id", "skill_id")


def resolved_decisions(refs: DataFrame, sources: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """ref, authority, freshness, content: the first of the sources (authority, freshness, DataFrame of ref, content) that has it."""
    out, content, authority, freshness = refs.select("ref"), [], F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, fresh, df) in enumerate(sources):
        out = out.join(df.select("ref", F.col("content").alias(f"c{i}")), "ref", "left")
        has = F.col(f"c{i}").isNotNull()
        authority, freshness = F.coalesce(authority, F.when(has, name)), F.coalesce(freshness, F.when(has, fresh))
        content.append(F.col(f"c{i}"))
    return out.select("ref", F.coalesce(authority, F.lit("unresolved")).alias("authority"), F.coalesce(freshness, F.lit("unavailable")).alias("freshness"), F.coalesce(*content).alias("content"))


EVENT_FIELDS = ["sequence", "repo_id", "event_type", "timestamp", "task_id", "payload"]


def chain_issues(log: DataFrame, repo: str, heads: DataFrame | None = None, genesis: str = "0" * 64) -> DataFrame:
    """log_id, sequence, issue of each fault: json, repo, sequence, previous, hash, head. Later rows are checked all the same.

    ``log``: log_id, EVENT_FIELDS, previous_hash, event_hash (sha256 of the previous hash and the fields by '|');
    ``heads``: log_id, head, the recorded hash of each log's last event. A log without rows has head at 0.
    """
    from .integrity import entry_hash

    w = Window.partitionBy("log_id").orderBy("sequence")
    faults = F.array(
        F.when(~F.coalesce(F.try_parse_json("payload").isNotNull(), F.lit(False)), "json"),
        F.when(F.col("repo_id") != repo, "repo"),
        F.when(F.col("sequence") != F.coalesce(F.lag("sequence").over(w) + 1, F.lit(1).cast("long")), "sequence"),
        F.when(F.col("previous_hash") != F.coalesce(F.lag("event_hash").over(w), F.lit(genesis)), "previous"),
        F.when(F.col("event_hash") != entry_hash(F.col("previous_hash"), *EVENT_FIELDS), "hash"),
    )
    rows = log.withColumn("issues", F.array_compact(faults)).select("log_id", "sequence", F.explode("issues").alias("issue"))
    if heads is None:
        return rows
    last = log.groupBy("log_id").agg(F.max("sequence").alias("sequence"), F.max_by("event_hash", "sequence").alias("own"))
    cut = heads.join(last, "log_id", "left").where(~F.col("own").eqNullSafe(F.col("head")))
    return rows.unionByName(cut.select("log_id", F.coalesce("sequence", F.lit(0).cast("long")).alias("sequence"), F.lit("head").alias("issue")))


def improved(baseline: DataFrame, replay: DataFrame) -> DataFrame:
    """task_id, improved: without denials, and shorter or of fewer actions (duration_ms, denials, actions)."""
    b = baseline.select("task_id", F.col("duration_ms").alias("was_ms"), F.col("actions").alias("was_actions"))
    better = (F.col("denials") == 0) & ((F.col("duration_ms") < F.col("was_ms")) | (F.col("actions") < F.col("was_actions")))
    return replay.join(b, "task_id").select("task_id", better.alias("improved"))


def unresolved_risks(checkpoints: DataFrame, tasks: DataFrame) -> DataFrame:
    """task_id, sequence, ordinal, label of the open risks that block, by each task's latest checkpoint.

    ``checkpoints``: task_id, sequence, open_risks (JSON array of objects); ``tasks``: task_id, risk.
    A high-risk task is blocked by any risk, another one only when some risk is high or critical.
    """
    last = checkpoints.groupBy("task_id").agg(F.max_by(F.struct("sequence", "open_risks"), "sequence").alias("c")).select("task_id", "c.*")
    risks = last.withColumn("r", F.from_json("open_risks", "array<struct<id:string,severity:string,high_risk:boolean>>")).join(tasks, "task_id")
    marked = F.exists("r", lambda x: F.coalesce(x["high_risk"], F.lit(False)) | F.coalesce(F.lower(x["severity"]).isin("high", "critical"), F.lit(False)))
    blocks = F.lower("risk").rlike("|".join(RISK_WORDS)) | marked
    return risks.where(blocks).select("task_id", "sequence", F.posexplode("r").alias("pos", "x")).select("task_id", "sequence", (F.col("pos") + 1).alias("ordinal"), F.coalesce("x.id", F.lit("unnamed risk")).alias("label"))


def seal_reasons(criteria: DataFrame, receipts: DataFrame, now: str) -> DataFrame:
    """task_id, criterion_id, reason (null: ready): the first failure of the latest receipt of each required criterion.

    ``criteria``: task_id, criterion_id, required (null counts as true), contract_digest, workspace, approval;
    ``receipts``: task_id, criterion_id, seq, status, contract_digest, workspace, expires_at.
    """
    last = receipts.groupBy("task_id", "criterion_id").agg(F.max_by(F.struct("status", "contract_digest", "workspace", "expires_at"), "seq").alias("r"))
    rows = criteria.where(F.coalesce("required", F.lit(True))).join(last, ["task_id", "criterion_id"], "left")
    r = F.col("r")
    reason = (
        F.when(r.isNull(), "no receipt").when(r["status"] != "pass", "status").when(r["contract_digest"] != F.col("contract_digest"), "contract changed").when(r["workspace"] != F.col("workspace"), "workspace changed")
        .when(F.col("approval") & (r["expires_at"] <= F.lit(now).cast("timestamp")), "approval expired").when(F.col("approval") & r["expires_at"].isNull(), "approval without expiry")
    )
    return rows.select("task_id", "criterion_id", reason.alias("reason"))


def authority_verdicts(cached: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """repo_id, verdict, absent: 'scope mismatch', 'conflict' with a fresh cached revision, or 'accept'.

    Both: repo_id, scope, revision; cached also expires_at; incoming also decisions and refs (arrays);
    ``absent`` are the refs that the snapshot doesn't allow.
    """
    c = cached.select("repo_id", F.col("scope").alias("was_scope"), F.col("revision").alias("was"), "expires_at")
    fresh = F.col("expires_at") > F.lit(now).cast("timestamp")
    verdict = F.when(F.col("was_scope") != F.col("scope"), "scope mismatch").when(fresh & (F.col("was") != F.col("revision")), "conflict").otherwise("accept")
    return incoming.join(c, "repo_id", "left").select("repo_id", verdict.alias("verdict"), F.array_sort(F.array_except("refs", "decisions")).alias("absent"))


def evaluation_issues(evaluations: DataFrame, skills: DataFrame, events: DataFrame) -> DataFrame:
    """evaluation_id, issues of each replay of a skill, in a fixed order.

    ``evaluations``: evaluation_id, skill_id, digest, task_id, source_task_id, status; ``skills``: skill_id,
    digest; ``events``: evaluation_id of those that the log backs.
    """
    s = skills.select("skill_id", F.col("digest").alias("own"))
    backed = events.select("evaluation_id").distinct().withColumn("backed", F.lit(True))
    rows = evaluations.join(s, "skill_id", "left").join(backed, "evaluation_id", "left")
    issues = F.array_compact(F.array(
        F.when(F.col("own").isNull(), "unknown skill"), F.when(F.col("own") != F.col("digest"), "digest changed"), F.when(F.col("task_id") == F.col("source_task_id"), "replay of its own source"),
        F.when(F.col("status") != "pass", "failed"), F.when(F.col("backed").isNull(), "no event"),
    ))
    return rows.select("evaluation_id", issues.alias("issues"))


def safety_violations(checkpoints: DataFrame) -> DataFrame:
    """task_id, violated: some checkpoint's input flags a violation or lists any."""
    listed = F.size(F.from_json(F.get_json_object("input", "$.safety_violations"), "array<string>")) > 0
    hit = (F.get_json_object("input", "$.safety_violation") == "true") | F.coalesce(listed, F.lit(False))
    return checkpoints.groupBy("task_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("violated"))


def redacted(tasks: DataFrame, hidden: list[str], receipts: str = "receipts") -> DataFrame:
    """The rows without the hidden columns, and the structs of the array column ``receipts`` without those fields."""
    keep = [f.name for f in tasks.schema[receipts].dataType.elementType.fields if f.name not in hidden]
    slim = F.transform(receipts, lambda r: F.struct(*(r[n].alias(n) for n in keep)))
    return tasks.drop(*(c for c in hidden if c in tasks.columns)).withColumn(receipts, slim)


def context_delta(events: DataFrame, checkpoints: DataFrame, contracts: DataFrame, decisions: DataFrame, skills: DataFrame) -> DataFrame:
    """What changed for each task since its latest checkpoint: task_id, kind, ref, digest.

    ``checkpoints``: task_id, sequence, event_sequence, contract_digest, refs (map of ref -> content digest).
    Kinds: 'event' (task_id, sequence, payload after the checkpoint's event), 'contract' (task_id, contract whose
    digest isn't the recorded one), 'decision' (``decisions``: task_id, ref, content, resolved anew) and 'skill'
    (``skills``: task_id, ref, content) whose digest is new or another one. Without a checkpoint all is new.
    """
    last = checkpoints.groupBy("task_id").agg(F.max_by(F.struct("event_sequence", "contract_digest", "refs"), "sequence").alias("c"))
    new = events.join(last, "task_id", "left").where(F.col("sequence") > F.coalesce("c.event_sequence", F.lit(-1)))
    out = new.select("task_id", F.lit("event").alias("kind"), F.col("sequence").cast("string").alias("ref"), F.sha2(F.col("payload"), 256).alias("digest"))
    now = contracts.join(last, "task_id", "left").withColumn("digest", F.sha2(F.col("contract"), 256))
    out = out.unionByName(now.where(~F.col("digest").eqNullSafe(F.col("c.contract_digest"))).select("task_id", F.lit("contract").alias("kind"), F.lit("contract").alias("ref"), "digest"))
    for kind, found in (("decision", decisions), ("skill", skills)):
        now = found.join(last, "task_id", "left").withColumn("digest", F.sha2(F.col("content"), 256))
        was = F.try_element_at("c.refs", F.col("ref"))
        out = out.unionByName(now.where(~F.col("digest").eqNullSafe(was)).select("task_id", F.lit(kind).alias("kind"), "ref", "digest"))
    return out


def promotion(skills: DataFrame, evaluations: DataFrame) -> DataFrame:
    """skill_id, verdict: 'promote' or the first gate that fails.

    ``skills``: skill_id, risk, sources (distinct sealed tasks), approval; ``evaluations``: skill_id,
    replay_task_id, status, improved. Replays count once each. High risk: an approval, one passed and one improved
    replay; else three sources, two passed and two improved.
    """
    ok = F.col("status") == "pass"
    runs = evaluations.groupBy("skill_id").agg(F.count_distinct(F.when(ok, F.col("replay_task_id"))).alias("passed"), F.count_distinct(F.when(ok & F.col("improved"), F.col("replay_task_id"))).alias("better"))
    rows = skills.join(runs, "skill_id", "left").withColumns({"passed": F.coalesce("passed", F.lit(0)), "better": F.coalesce("better", F.lit(0))})
    high = F.lower("risk").rlike("|".join(RISK_WORDS))
    need = F.when(high, 1).otherwise(2)
    verdict = (
        F.when(high & (F.coalesce("approval", F.lit("")) == ""), "no approval").when(~high & (F.size(F.array_distinct("sources")) < 3), "too few sources")
        .when(F.col("passed") < need, "too few passed replays").when(F.col("better") < need, "too few improved replays").otherwise("promote")
    )
    return rows.select("skill_id", verdict.alias("verdict"))


def demotion(skills: DataFrame, outcomes: DataFrame, policy: int, now: str) -> DataFrame:
    """skill_id, reasons (in a fixed order; empty: none) of skills that can't stay promoted.

    ``skills``: skill_id, schema_version, policy_version, proof_expires_at; ``outcomes``: skill_id, status, issues.
    """
    bad = F.col("status") == "fail"
    runs = outcomes.groupBy("skill_id").agg(F.count_if(bad).alias("failures"), F.bool_or(bad & F.exists("issues", lambda x: x.contains("safety violation"))).alias("unsafe"))
    rows = skills.join(runs, "skill_id", "left")
    expiry = F.col("proof_expires_at")
    reasons = F.array(
        F.when(~F.col("schema_version").eqNullSafe(F.lit(1)), "schema"), F.when(~F.col("policy_version").eqNullSafe(F.lit(policy)), "policy"),
        F.when(expiry.isNull(), "no proof expiry").when(expiry + F.expr("interval 30 days") < F.lit(now).cast("timestamp"), "proof expired"),
        F.when(F.col("failures") >= 3, F.concat(F.col("failures").cast("string"), F.lit(" failures"))), F.when(F.col("unsafe"), "safety violation"),
    )
    return rows.select("skill_id", F.array_compact(reasons).alias("reasons"))


def release_report(events: DataFrame, tasks: DataFrame, started: str, now: str, chain_valid: bool, attested: bool) -> DataFrame:
    """One row: managed, sealed, blocked and failed tasks, elapsed days, blockers and ready.

    ``events``: task_id, event_type, ts; ``tasks``: task_id, status. A task is managed if it was created since the start.
    """
    managed = events.where((F.col("event_type") == "task_created") & (F.col("ts") >= F.lit(started).cast("timestamp"))).select("task_id").distinct()
    known = managed.join(tasks, "task_id", "left")
    ids = lambda status: F.array_sort(F.collect_set(F.when(F.col("status") == status, F.col("task_id"))))
    days = F.lit(now).cast("timestamp").cast("long") - F.lit(started).cast("timestamp").cast("long")
    row = known.agg(F.count("*").alias("managed"), F.count_if(F.col("status") == "sealed").alias("sealed"), ids("blocked").alias("blocked"), ids("failed").alias("failed"), F.count_if(F.col("status").isNull()).alias("unread"))
    row = row.withColumn("days", F.greatest(F.floor(days / 86400), F.lit(0)))
    blockers = F.array(
        F.when(F.col("unread") > 0, "unreadable tasks"), F.when(F.lit(not chain_valid), "chain"), F.when(F.col("days") < 30, F.concat(F.col("days").cast("string"), F.lit("/30 days"))),
        F.when(F.col("managed") < 100, F.concat(F.col("managed").cast("string"), F.lit("/100 tasks"))), F.when(F.lit(not attested), "no attestation"),
    )
    return row.withColumn("blockers", F.array_compact(blockers)).withColumn("ready", F.size("blockers") == 0).drop("unread")


def candidates(tasks: DataFrame, need: int = 3) -> DataFrame:
    """task_type, allowed_paths, sources (sealed tasks, sorted), missing: how many more a skill needs. Paths are compared in order."""
    sealed = tasks.where("status = 'sealed'").groupBy("task_type", "allowed_paths").agg(F.array_sort(F.collect_set("task_id")).alias("sources"))
    return sealed.withColumn("missing", F.greatest(F.lit(0), F.lit(need) - F.size("sources")))


def failures_and_risks(receipts: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """task_id, kind, ref: failed receipts (task_id, criterion_id, status) and checkpoints (task_id, sequence, open_risks) that list risks."""
    bad = receipts.where("status = 'fail'").select("task_id", F.lit("failed receipt").alias("kind"), F.col("criterion_id").cast("string").alias("ref"))
    open_ = checkpoints.where(F.coalesce(F.json_array_length("open_risks"), F.lit(0)) > 0)
    return bad.unionByName(open_.select("task_id", F.lit("open risks").alias("kind"), F.col("sequence").cast("string").alias("ref")))


def versions(log: DataFrame) -> DataFrame:
    """slot_id, memory_id, is_latest, tombstoned of a log (seq, op, memory_id) of saves and deletes by id.

    A save of a known id is a new slot and outdates the one before; a delete buries the current slot.
    """
    w = Window.partitionBy("memory_id").orderBy("seq")
    rows = log.withColumn("then", F.lead("op").over(w)).where("op = 'save'")
    return rows.select(F.col("seq").alias("slot_id"), "memory_id", (~F.coalesce(F.col("then") == "save", F.lit(False))).alias("is_latest"), F.coalesce(F.col("then") == "delete", F.lit(False)).alias("tombstoned"))


def related(saves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From saves (slot_id, relation, target): edges of weight 255, and the targets that an update outdates."""
    names = F.create_map(*(F.lit(x) for kv in {"mention": 1, "update": 2, "derive": 3, "contradict": 4, "part_of": 5, "extend": 6}.items() for x in kv))
    linked = saves.where("relation is not null and target is not null")
    edges = linked.select(F.col("slot_id").alias("src"), F.col("target").alias("dst"), names[F.col("relation")].alias("edge_type"), F.lit(255).alias("weight")).where("edge_type is not null")
    return edges, linked.where("relation = 'update'").select(F.col("target").alias("slot_id")).distinct()


def newest_tagged(records: DataFrame, tags: DataFrame) -> DataFrame:
    """tag, slot_id: of (slot_id, tags, valid_from_ns) the newest one with each wanted tag, the smallest slot at ties."""
    held = records.select("slot_id", "valid_from_ns", F.explode(F.array_distinct("tags")).alias("tag")).join(tags.select("tag").distinct(), "tag", "left_semi")
    return held.groupBy("tag").agg(F.max_by("slot_id", F.struct("valid_from_ns", -F.col("slot_id"))).alias("slot_id"))


def decision_record(decision: Column, rationale: Column, alternatives: Column, files: Column, tags: Column) -> tuple[Column, Column]:
    """Text and tags of a logged decision; empty lists leave no line."""
    text = F.concat_ws("\n", F.concat(F.lit("Decision: "), decision), F.concat(F.lit("Rationale: "), rationale), F.when(F.size(alternatives) > 0, F.concat(F.lit("Alternatives considered: "), F.array_join(alternatives, "; "))), F.when(F.size(files) > 0, F.concat(F.lit("Affected files: "), F.array_join(files, ", "))))
    return text, F.concat(tags, F.array(F.lit("decision")), F.transform(files, lambda f: F.concat(F.lit("file:"), f)))


def normalised_save(rows: DataFrame) -> DataFrame:
    """Calls (title, content, tags, entities, memory_type) that can be saved, trimmed and bounded; others are left out."""
    from .structured import normalised_tags

    ok = (F.trim("title") != "") & (F.trim("content") != "")
    kind = F.when(F.col("memory_type").isin(KINDS), F.col("memory_type")).otherwise("fact")
    return rows.where(ok).withColumns({"title": F.substring(F.trim("title"), 1, 160), "content": F.trim("content"), "tags": normalised_tags(F.col("tags")), "entities": normalised_tags(F.col("entities"), 12), "memory_type": kind})


def transcript(blocks: DataFrame, block_max: int, total_max: int) -> DataFrame:
    """session, text: role-tagged lines of (session, ordinal, role, text), long blocks cut, the last ``total_max`` characters.

    One session is one row; its lines are gathered in order.
    """
    t = F.trim(F.coalesce("text", F.lit("")))
    cut = F.when(F.char_length(t) > block_max, F.concat(F.substring(t, 1, block_max), F.lit("…[truncated]"))).otherwise(t)
    name = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "tool", "  -> ").otherwise("Assistant: ")
    lines = blocks.where(t != "").select("session", F.struct("ordinal", F.concat(name, cut).alias("line")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return lines.groupBy("session").agg(text.alias("text")).select("session", F.expr(f"right(text, {total_max})").alias("text"))


def chained(log: DataFrame) -> DataFrame:
    """Adds previous_hash and event_hash to (log_id, EVENT_FIELDS)."""
    from . import integrity

    return integrity.chained(log, "log_id", EVENT_FIELDS, ("previous_hash", "event_hash"))
