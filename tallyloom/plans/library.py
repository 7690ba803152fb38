"""Queries that feed the library's own functions with rows of the tables: stores, archives, rule packs, scans, operations.

Where a plan of ``reports`` says the same in SQL, it is the oracle: the names are the same, and the query here takes its place.
"""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars as s
from tallyloom.functions.dialect import DUCK, SPARK
from tallyloom.operators import archive, lifecycle, pack, pruning, reduce, rule_data, selection
from tallyloom.plans.corpus import ctes
from tallyloom.plans.programs import ORACLES, _commands, corpus, query
from tallyloom.sources import agents, jsonl, store
from tallyloom.streaming import automaton, frames


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, below spark.checkpoint.dir; on a single machine without one, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    return f"{path}/{name}-{uuid.uuid4().hex}"


# The store's merges.


@query
def k2_merge_first_wins(spark, sf_dir):
    """Staged rows join the stored ones (``store.merged``): the first of each key by source order, none that is stored."""
    calls = corpus(spark, sf_dir, "select call_key, doc_id, input_text from tool_calls")
    stored = calls.where("doc_id % 3 = 0").select("call_key", "doc_id", F.lit(-1).alias("batch"), "input_text")
    one = lambda rows, n, more: rows.select("call_key", "doc_id", F.lit(n).alias("batch"), F.concat("input_text", F.lit(more)).alias("input_text"))
    staged = one(calls.where("doc_id % 2 = 0"), 0, "").unionByName(one(calls.where("doc_id % 5 = 0"), 1, "!"))
    return store.merged(stored, staged, "call_key", ("batch", "doc_id")).where("batch >= 0").select("call_key", "batch", F.length("input_text").alias("chars"))


@query
def k3_upsert_items(spark, sf_dir):
    """Newer items in place of the stored ones of their key (``store.upserted``)."""
    seen = corpus(spark, sf_dir, "select source_item_key, line_number from observations")
    old = seen.select("source_item_key").distinct().select("source_item_key", F.lit(1).alias("version"), F.lit(None).cast("bigint").alias("size"))
    new = seen.where("line_number % 3 = 0").groupBy("source_item_key").agg(F.lit(2).alias("version"), F.max("line_number").alias("size"))
    return store.upserted(old, new, "source_item_key")


@query
def k5_reset_source(spark, sf_dir):
    """Results and calls that no other source observed go with their source (``store.without_source``)."""
    rows = lambda names, table: corpus(spark, sf_dir, f"select {names} from {table}")
    _, results, calls = store.without_source(rows("source_item_key, call_key, result_key", "observations"), rows("result_key, call_key", "tool_results"), rows("call_key", "tool_calls"), "src3")
    return results.select(F.lit("result").alias("kind"), F.col("result_key").alias("id")).unionByName(calls.select(F.lit("call").alias("kind"), F.col("call_key").alias("id")))


@query
def k16_prune(spark, sf_dir):
    """What is left when finished calls before a time go (``archive.prune``): payloads that a kept call still needs, with their snapshots."""
    rows = corpus(spark, sf_dir, "select r.call_key, c.doc_id, sha2(r.output_text, 256) as sha256 from tool_results r join tool_calls c on r.call_key = c.call_key")
    left, kept = archive.prune(rows.select("sha256").distinct(), rows.select("call_key", "sha256"), rows.where("doc_id < 300 and doc_id % 4 <> 0").select("call_key"))
    return kept.join(left, "sha256").groupBy("sha256").agg(F.count("*").alias("snapshots"))


# The reducer's gate, over the lengths of real summaries.


@query
def r20_gate(spark, sf_dir):
    """Whether a log summary of each result replaces its text (``reduce.reduce_text``), and whether its length says so (the gate in SQL)."""
    rows = corpus(spark, sf_dir, "select result_key, output_text from tool_results", deal=True)

    def run(batches):
        policy = reduce.Policy()
        for b in batches:
            raw = [t.encode() for t in b["output_text"]]
            small = [len(reduce.summarise("log", r, policy, False)) for r in raw]
            took = [reduce.reduce_text("log", r, policy, policy, False) != r for r in raw]
            yield b[["result_key"]].assign(raw=list(map(len, raw)), small=small, reduced=took)

    policy = reduce.Policy()
    gate = f"raw > {policy.output} or (small < raw and raw - small >= {policy.least} and (raw - small) * 10000 >= raw * {policy.points})"
    found = rows.mapInPandas(run, "result_key string, raw long, small long, reduced boolean")
    return found.groupBy(F.expr(f"({gate}) = reduced").alias("agrees"), F.expr(f"raw > {policy.output}").alias("long")).agg(F.count("*").alias("results"), F.sum("raw").alias("bytes"))


ORACLES["r20_gate"] = f"with {ctes(DUCK)} select true as agrees, strlen(output_text) > {reduce.Policy().output} as long, count(*) as results, cast(sum(strlen(output_text)) as bigint) as bytes from tool_results group by 1, 2"


# Rule packs: every source of the documents brings a pack of the rules that its documents name.


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled packs: pack_id, rule_id, program, ..., record, record_sha256; some records were changed after they were compiled."""
    rules = sorted(rule_data.rules(), key=lambda r: r["id"])
    shaped = [{"id": r["id"], "action": r["action"], "match": {"program": list(r["programs"]), "argv_prefix": list(r["argv_prefix"]), "argv_contains_all": list(r["contains"])}, **({"reducer": {"kind": r["reducer"]}} if r["reducer"] else {})} for r in rules]
    table = pack.compiled(spark, "", shaped).drop("pack_id")
    place = spark.createDataFrame([(k, r["id"]) for k, r in enumerate(rules)], "k long, rule_id string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("source").alias("pack_id"), (F.col("doc_id") % len(rules)).alias("k")).agg(F.max(F.col("doc_id") % 13 == 0).alias("changed"))
    own = docs.join(F.broadcast(place), "k").join(F.broadcast(table), "rule_id")
    return own.withColumn("record", F.when(F.col("changed"), F.concat("record", F.lit(" "))).otherwise(F.col("record"))).drop("k", "changed")


@query
def c9_pack_conflicts(spark, sf_dir):
    """Packs of which each source brings one (``pack.usable``): how many rules each has, and how many it keeps where no other pack claims their ids."""
    packs = _packs(spark, sf_dir)
    kept = pack.usable(packs).groupBy("pack_id").agg(F.countDistinct("rule_id").alias("kept"))
    return packs.groupBy("pack_id").agg(F.countDistinct("rule_id").alias("rules")).join(kept, "pack_id", "left").fillna(0, ["kept"])


_N = len(rule_data.rules())
ORACLES["c9_pack_conflicts"] = f"""
with p as (select distinct source as pack_id, doc_id % {_N} as k from documents),
o as (select k from p group by k having count(*) = 1)
select p.pack_id, count(*) as rules, count(o.k) as kept from p left join o on p.k = o.k group by p.pack_id"""


@query
def c21_verify(spark, sf_dir):
    """Packs of which each source brings one (``pack.damaged``): how many rules of each no longer have the digest that they were compiled with."""
    packs = _packs(spark, sf_dir)
    bad = pack.damaged(packs).groupBy("pack_id").agg(F.countDistinct("rule_id").alias("damaged"))
    return packs.groupBy("pack_id").agg(F.countDistinct("rule_id").alias("rules")).join(bad, "pack_id", "left").fillna(0, ["damaged"])


ORACLES["c21_verify"] = f"""
with p as (select source as pack_id, doc_id % {_N} as k, bool_or(doc_id % 13 = 0) as changed from documents group by 1, 2)
select pack_id, count(*) as rules, count(*) filter (changed) as damaged from p group by pack_id"""


@query
def c21_rules(spark, sf_dir):
    """Every rule with what it does, under which limits, in how much memory, and how many of the corpus's commands and calls name it."""
    rows = [(r["id"], r["action"], "+".join(r["programs"]), " ".join(r["argv_prefix"]), "+".join(r["contains"]), r["reducer"], r["line_bytes"], r["failure_line_bytes"], r["least"]) for r in rule_data.rules()]
    table = spark.createDataFrame(rows, "rule_id string, action string, programs string, prefix string, needed string, reducer string, line_bytes long, failure_line_bytes long, least long")
    full = table.withColumns({"output_bytes": F.lit(reduce.Policy.output), "failure_output_bytes": F.lit(reduce.Policy.output), "pattern_bytes": F.lit(0)})
    full = full.withColumn("memory_bound", F.when(F.col("action") == "reduce", pack.memory_bound(full))).drop("output_bytes", "failure_output_bytes", "pattern_bytes")
    calls = _commands(spark, sf_dir)
    n = calls.groupBy("command").agg(F.count("*").alias("calls"))
    named = n.join(selection.select_simple(selection.argv(calls), selection.rule_table(spark)), "command").select("calls", F.explode("rule_ids").alias("rule_id"))
    named = named.groupBy("rule_id").agg(F.count("*").alias("commands"), F.sum("calls").alias("calls"))
    return full.join(named, "rule_id", "left").fillna(0, ["commands", "calls"])


@query
def c21_named(spark, sf_dir):
    """Rules that the corpus's commands name, with how many calls: what ``c21_rules`` shows of them."""
    return c21_rules(spark, sf_dir).where("calls > 0").select("rule_id", "action", "calls")


def _named_oracle() -> str:
    """Over the selection's own oracle, which gives each command's rules."""
    return f"with s as ({ORACLES['c8_selection']}), n as (select unnest(string_split(rules, '+')) as rule_id, calls from s where rules <> ''), r(rule_id, action) as (values {', '.join(repr((r['id'], r['action'])) for r in rule_data.rules())}) select n.rule_id, r.action, cast(sum(calls) as bigint) as calls from n join r on n.rule_id = r.rule_id group by 1, 2"


ORACLES["c21_named"] = _named_oracle()


# Words and bodies of the documents.


@query
def p13_word_shapes(spark, sf_dir):
    from tallyloom.plans.registry import run_plan

    return run_plan(spark, sf_dir, _word_shapes)


def _word_shapes(d) -> str:
    """Assignments and references among words made of each document's first word and digest."""
    w = d.sha("coalesce(text, '')")
    word = f"""case doc_id % 7 when 0 then lang || '=1' when 1 then '_' || source || '=' when 2 then '9' || lang || '=1' when 3 then lang || '-b=1' when 4 then 'yr_' || substring({w}, 1, 32) when 5 then 'yr_' || upper(substring({w}, 1, 32)) else upper(lang) end"""
    return f"with w as (select doc_id, {word} as w from documents) select doc_id, {s.assignment(d, 'w')} as assignment, {s.archive_ref_ok(d, 'w')} as archive_ref from w"


ORACLES["p13_word_shapes"] = _word_shapes(DUCK)


@query
def p16_media_types(spark, sf_dir):
    """The media type of each whole body: some end in the middle of a character, some have a byte that no text has."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    body = F.when(F.col("doc_id") % 7 == 0, F.concat(raw, F.unhex(F.lit("E282")))).when(F.col("doc_id") % 7 == 1, F.concat(F.unhex(F.lit("FF")), raw)).when(F.col("doc_id") % 7 == 2, F.expr("substring(encode(coalesce(text, ''), 'UTF-8'), 1, greatest(octet_length(coalesce(text, '')) - 1, 0))")).otherwise(raw)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", body.alias("body"))
    return rows.select("doc_id", F.octet_length("body").cast("long").alias("bytes"), F.expr(archive.media_type("body")).alias("media_type"))


ORACLES["p16_media_types"] = """
with h as (select doc_id, doc_id % 7 as k, coalesce(text, '') as t, strlen(coalesce(text, '')) as n from documents)
select doc_id, case k when 0 then n + 2 when 1 then n + 1 when 2 then greatest(n - 1, 0) else n end as bytes,
  case when k < 2 or k = 2 and strlen(right(t, 1)) > 1 then 'application/octet-stream' else 'text/plain; charset=utf-8' end as media_type from h"""


# Scans: the documents' lines as files, one for each source, and what an import does when they have grown.


def _lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, doc_id and a JSON line of each document; no line feed is inside."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("source", "doc_id", F.concat(F.lit('{"doc_id":'), F.col("doc_id"), F.lit(',"bytes":'), F.octet_length("text"), F.lit(',"lang":"'), F.col("lang"), F.lit('"}')).alias("value"))


_LINE = """'{"doc_id":' || doc_id || ',"bytes":' || strlen(text) || ',"lang":"' || lang || '"}'"""


def _as_files(rows: DataFrame, folder: str) -> list[str]:
    """One file of lines for each source, in the order of doc_id."""
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(folder)
    found = jsonl.files(rows.sparkSession, folder, "part-*.txt")
    return [r["path"] for r in found.select("path").collect()]  # a file for each source


def _source() -> F:
    return F.regexp_extract("path", "source=([^/]+)/", 1)


@query
def s2_scan(spark, sf_dir):
    """The documents' lines written as files and scanned: number, offset and digest of every line (``jsonl.scan``, ``jsonl.lines``)."""
    paths = _as_files(_lines_of(spark, sf_dir), scratch(spark, "s2"))
    found = jsonl.lines(jsonl.scan(spark, paths))
    return found.select(_source().alias("source"), "line_no", "byte_offset", "record_sha256", "valid")


ORACLES["s2_scan"] = f"""
with l as (select source, doc_id, {_LINE} as value from documents)
select source, row_number() over w as line_no, cast(coalesce(sum(strlen(value) + 1) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_offset,
  sha256(value) as record_sha256, true as valid from l window w as (partition by source order by doc_id)"""


@query
def s4_resume(spark, sf_dir):
    """The files again after they have grown: what an import reads past its checkpoints, and which start again as their beginning has changed (``jsonl.checkpoints``, ``jsonl.lines``)."""
    lines, folder = _lines_of(spark, sf_dir), scratch(spark, "s4")
    middle = lines.agg(F.max("doc_id")).first()[0] or 0
    before = jsonl.scan(spark, _as_files(lines.where(F.col("doc_id") < middle // 2), f"{folder}/before"))
    known = jsonl.checkpoints(before).withColumn("source", _source())
    changed = F.when((F.length("source") % 2 == 0) & (F.col("doc_id") % 50 == 3), F.upper("value")).otherwise(F.col("value"))
    now = _as_files(lines.withColumn("value", changed), f"{folder}/after")
    paths = jsonl.files(spark, f"{folder}/after", "part-*.txt").select("path", _source().alias("source"))
    known = known.drop("path").join(paths, "source").drop("source")
    found = jsonl.lines(jsonl.scan(spark, now), known)
    return found.groupBy(_source().alias("source"), "reset").agg(F.count("*").alias("lines"), F.min("line_no").alias("first"), F.sum("byte_offset").alias("offsets"))


ORACLES["s4_resume"] = f"""
with l as (select source, doc_id, {_LINE} as value, doc_id < (select max(doc_id) from documents) // 2 as old, length(source) % 2 = 0 and doc_id % 50 = 3 as changed from documents),
p as (select *, row_number() over (partition by source order by doc_id) as line_no, coalesce(sum(strlen(value) + 1) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as byte_offset from l),
r as (select source, bool_or(old) as known, bool_or(old and changed) as reset from l group by source)
select p.source, r.reset, count(*) as lines, min(line_no) as first, cast(sum(byte_offset) as bigint) as offsets from p join r on p.source = r.source where r.reset or not p.old group by p.source, r.reset"""


# The archive's operations, applied.


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lifecycle.OPERATIONS`` of the event log: a user is a session of three calls, an event an operation."""
    session = "named_struct('agent', 'a', 'account', 'b', 'sourceSessionId', cast(user_id as string))"
    head = f"'requestId', event_id, 'schemaVersion', case when event_id % 31 = 0 then 2 else 1 end, 'session', {session}"
    call = "cast(event_id % 3 as string)"
    ops = {
        "signup": f"'operation', 'begin_call', 'call', named_struct('sourceCallId', {call}, 'toolName', 'bash', 'startedAtMs', 0, 'requiresStreams', false), 'inputBefore', user_id, 'inputAfter', user_id, 'capturedAtMs', event_id",
        "view": f"'operation', 'result_before', 'sourceCallId', {call}, 'result', event_id % 2, 'capturedAtMs', event_id",
        "click": f"'operation', 'result_text', 'sourceCallId', {call}, 'text', props, 'sourceCompleteness', 'unknown', 'capturedAtMs', event_id",
        "error": f"'operation', 'stage_result', 'sourceCallId', {call}, 'result', event_id % 2, 'isError', value > 50, 'capturedAtMs', event_id",
    }
    finish = f"'operation', 'finish_call', 'sourceCallId', {call}, 'result', event_id % 2, 'isError', value > 50, 'requirePreResult', true, 'finishedAtMs', event_id"
    message = "case event_type " + " ".join(f"when '{k}' then to_json(named_struct({head}, {v}))" for k, v in ops.items()) + f" else to_json(named_struct({head}, {finish})) end"
    key = F.sha2(F.concat_ws("\0", F.lit("a"), F.lit("b"), F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")), 256)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
    return events.select(F.lit("events").alias("stream"), F.col("event_id").alias("seq"), F.col("event_id").alias("request_id"), key.alias("call_key"), F.expr(message).alias("message"), F.lit(None).cast("binary").alias("full_output"))


@query
def k13_applied(spark, sf_dir):
    """Every call after the event log's operations were applied in order (``lifecycle.changes``): its state, how many operations it took and refused, its snapshots."""
    rows = lifecycle.changes(_operations(spark, sf_dir))
    folder = scratch(spark, "k13")
    rows.drop("body").write.parquet(folder)  # read by three tables
    rows = spark.read.parquet(folder)
    told = rows.where("kind = 'answer'").groupBy("call_key").agg(F.count_if(F.col("error").isNull()).alias("taken"), F.count_if(F.col("error").isNotNull()).alias("refused"))
    own = lifecycle.calls(rows).select("call_key", "source_session_id", "source_call_id", "status", "is_error", "executed", "finished_at_ms")
    places = lifecycle.snapshots(rows).groupBy("call_key").agg(F.count("*").alias("snapshots"), F.max("captured_at_ms").alias("last_captured"))
    return told.join(own, "call_key", "left").join(places, "call_key", "left")


ORACLES["k13_applied"] = r"""
with e as (select sha256('a' || chr(0) || 'b' || chr(0) || user_id || chr(0) || event_id % 3) as call_key, user_id, event_id % 3 as call, event_id as seq, event_type as kind, event_id % 2 as k, props, value > 50 as err, event_id % 31 <> 0 as fits from events where user_id is not null),
b as (select *, min(seq) filter (where kind = 'signup' and fits) over (partition by call_key) as b0 from e),
n as (select *, fits and b0 is not null and seq >= b0 as on_ from b),
v as (select *, min(seq) filter (where on_ and kind = 'view') over (partition by call_key) as v0, arg_min(k, seq) filter (where on_ and kind = 'view') over (partition by call_key) as vk,
  min(seq) filter (where on_ and kind = 'click') over (partition by call_key) as t0, arg_min(props, seq) filter (where on_ and kind = 'click') over (partition by call_key) as tk from n),
a as (select *, min(seq) filter (where on_ and seq > v0 and kind not in ('signup', 'view', 'click')) over (partition by call_key) as a0,
  arg_min(k, seq) filter (where on_ and seq > v0 and kind not in ('signup', 'view', 'click')) over (partition by call_key) as ak from v),
f as (select *, min(seq) filter (where on_ and seq >= a0 and k = ak and kind not in ('signup', 'view', 'click', 'error')) over (partition by call_key) as f0 from a),
o as (select *, on_ and case kind when 'signup' then true when 'view' then k = vk when 'click' then props = tk when 'error' then coalesce(seq >= a0 and k = ak and (f0 is null or seq < f0), false) else coalesce(seq >= a0 and k = ak, false) end as ok from f)
select call_key, count(*) filter (ok) as taken, count(*) filter (not ok) as refused, case when max(b0) is not null then cast(any_value(user_id) as varchar) end as source_session_id, case when max(b0) is not null then cast(any_value(call) as varchar) end as source_call_id,
  case when max(b0) is null then null when max(f0) is not null then 'finished' else 'started' end as status, arg_max(err, seq) filter (ok and kind not in ('signup', 'view', 'click')) as is_error,
  case when max(b0) is not null then max(a0) is not null end as executed, max(seq) filter (ok and kind not in ('signup', 'view', 'click', 'error')) as finished_at_ms,
  case when max(b0) is not null then 2 + count(distinct v0) + count(distinct t0) + count(distinct a0) end as snapshots, greatest(max(b0), max(v0), max(t0), max(a0)) as last_captured from o group by call_key"""


# Framed streams, through the automaton.


@query
def s11_automaton(spark, sf_dir):
    """Streams that are framed by the events' places, a user each: what breaks each, and what was committed until then (``automaton``)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
    own = e.selectExpr("cast(user_id as string) as stream", "event_id + 1 as seq", "event_type", "row_number() over (partition by user_id order by event_id) as n")
    record = """case when seq % 397 = 0 then 'stream_end' when n % 5 = 1 then 'source_start' when n % 5 in (2, 3) then case event_type when 'view' then 'tool_call' when 'click' then 'tool_result' else 'session' end
      when n % 5 = 4 then case event_type when 'purchase' then 'source_rollback' else 'source_commit' end else 'source_root' end"""
    ends = own.groupBy("stream").agg(F.max("seq").alias("last")).selectExpr("stream", "inline(array(struct(0L as seq, 'stream_start' as record), struct(last + 1 as seq, 'stream_end' as record)))").where("seq = 0 or cast(stream as bigint) % 7 <> 0")
    rows, folder = automaton.placed(own.selectExpr("stream", "seq", f"{record} as record").unionByName(ends), part=1000), scratch(spark, "s11")
    rows.write.parquet(folder)  # read by four tables
    rows = spark.read.parquet(folder)
    kept = automaton.committed(rows).groupBy("stream").agg(F.count("*").alias("committed"), F.countDistinct("source").alias("sources"))
    every = rows.select("stream").distinct()
    return every.join(automaton.faults(rows), "stream", "left").join(kept, "stream", "left").fillna(0, ["committed", "sources"])


ORACLES["s11_automaton"] = f"""
with o as (select cast(user_id as varchar) as stream, event_id + 1 as seq, event_type, row_number() over (partition by user_id order by event_id) as n from events where user_id is not null),
r as (select stream, seq, case when seq % 397 = 0 then 'stream_end' when n % 5 = 1 then 'source_start' when n % 5 in (2, 3) then 'record' when n % 5 = 4 then case event_type when 'purchase' then 'source_rollback' else 'source_commit' end else 'source_root' end as record from o
  union all select stream, 0, 'stream_start' from o group by stream union all select stream, max(seq) + 1, 'stream_end' from o where cast(stream as bigint) % 7 <> 0 group by stream),
k as (select *, case record when 'stream_start' then 1 when 'stream_end' then 2 when 'source_start' then 3 when 'source_commit' then 4 when 'source_rollback' then 4 when 'source_root' then 5 else 6 end as k, row_number() over (partition by stream order by seq) as i from r),
l as (select stream, list(k order by seq) as ks from k group by stream),
p as (select k.*, list_reduce(list_prepend(0::bigint, l.ks[1:i - 1]), lambda s, c: {automaton.NEXT}[c][s + 1]) as place from k join l on k.stream = l.stream),
q as (select *, {automaton.NEXT}[k][place + 1] as after, sum(case when k = 3 then 1 else 0 end) over (partition by stream order by seq) as source from p),
f as (select stream, min(seq) as seq, arg_min(case when k = 2 and place = 2 then 'stream ended before its source committed' else {automaton.FAULTS}[k] end, seq) as fault from q where place <> 4 and after = 4 group by stream
  union all select stream, null, case max_by(after, seq) when 2 then 'stream ended with an active source' else 'stream ended without a completion record' end from q group by stream having max_by(after, seq) not in (3, 4)),
d as (select stream, source from q where record = 'source_commit' and place = 2),
c as (select q.stream, q.source from q join d on q.stream = d.stream and q.source = d.source where k = 6 and place = 2 union all select stream, source from q where k = 5 and place = 1),
n as (select stream, count(*) as committed, count(distinct source) as sources from c group by stream)
select s.stream, f.seq, f.fault, coalesce(committed, 0) as committed, coalesce(sources, 0) as sources from (select distinct stream from k) s left join f on s.stream = f.stream left join n on s.stream = n.stream"""


# Shell words, labels and options, over variants of the corpus's commands.

_PLAIN = "not regexp_matches(command, '[|&;<>]')"


@query
def c2_words(spark, sf_dir):
    """The corpus's simple commands with every word plain, quoted in either way or escaped: the words that come out."""
    simple = corpus(spark, sf_dir, f"select distinct {s.shell_command(SPARK, 'tool_name', 'input_format', 'input_text')} as command, doc_id % 4 as k from tool_calls").where("command is not null and not command rlike '[|&;<>]'")
    word = """case (i + k) % 4 when 0 then w when 1 then concat("'", w, "'") when 2 then concat('"', w, '"') else regexp_replace(w, '(.)', '\\\\\\\\$1') end"""
    spelled = simple.select(F.expr(f"array_join(transform(split(command, ' '), (w, i) -> {word}), ' ')").alias("command"))
    return selection.argv(spelled).select("command", F.array_join("argv", "|").alias("words"))


_SHELL = s.shell_command(DUCK, "tool_name", "input_format", "input_text")
ORACLES["c2_words"] = f"""
with {ctes(DUCK)},
c as (select distinct {_SHELL} as command, doc_id % 4 as k from tool_calls),
p as (select * from c where command is not null and {_PLAIN})
select distinct array_to_string(list_transform(string_split(command, ' '), lambda w, i: case (i - 1 + k) % 4 when 0 then w when 1 then '''' || w || '''' when 2 then '"' || w || '"' else regexp_replace(w, '(.)', chr(92) || chr(92) || chr(92) || '1', 'g') end), ' ') as command,
  array_to_string(string_split(command, ' '), '|') as words from p"""

#: Ways to put a command into others, and the labels of each, by hand.
_AROUND = [
    ("{} | cat", "pipeline"), ("{} && true", "and_list"), ("{} || true", "or_list"), ("{}; true", "sequence"), ("{} &", "background"), ("{}\ntrue", "multiline"), ("echo $HOME; {}", "sequence+parameter_expansion"),
    ("echo $(pwd); {}", "sequence+command_substitution"), ("{} > out", "redirection"), ("{} # note", "comment"), ("cat <<EOF\n{}\nEOF", "multiline+redirection+heredoc"), ("while true; do {}; done", "sequence+loop"),
    ("if true; then {}; fi", "sequence+conditional"), ("f() {{ {}; }}", "sequence+function"), ("( {} )", "subshell"), ("/usr/bin/nice {}", "path_invocation"), ("env {}", "wrapper"), ("bash -c '{}'", "nested_shell"), ("echo 'open; {}", "parser_failure"),
]


@query
def c4_labels(spark, sf_dir):
    """All syntax labels (``shell.features``): the corpus's simple commands put into others in nineteen ways, calls by label."""
    shaped = " ".join(f"when {k} then {_concat(t)}" for k, (t, _) in enumerate(_AROUND))
    calls = corpus(spark, sf_dir, f"select {s.shell_command(SPARK, 'tool_name', 'input_format', 'input_text')} as command, doc_id from tool_calls").where("command is not null and not command rlike '[|&;<>/]' and not command like 'timeout %'")
    calls = calls.select(F.expr(f"case doc_id % {len(_AROUND)} {shaped} end").alias("command"))
    n = calls.groupBy("command").agg(F.count("*").alias("calls"))
    return n.join(selection.syntax(calls), "command").select(F.explode("labels").alias("label"), "calls").groupBy("label").agg(F.sum("calls").alias("calls"), F.count("*").alias("commands"))


def _concat(template: str) -> str:
    """SQL of a template with the command in it."""
    before, after = template.replace("{{", "\0").replace("}}", "\1").split("{}")
    q = lambda x: "'" + x.replace("\0", "{").replace("\1", "}").replace("'", "\\'").replace("\n", "\\n") + "'"
    return f"concat({q(before)}, command, {q(after)})"


ORACLES["c4_labels"] = f"""
with {ctes(DUCK)},
c as (select {_SHELL} as command, doc_id % {len(_AROUND)} as k from tool_calls),
l(k, labels) as (values {', '.join(f"({k}, '{x}')" for k, (_, x) in enumerate(_AROUND))}),
u as (select command, c.k, unnest(string_split(labels, '+')) as label from c join l on c.k = l.k where command is not null and not regexp_matches(command, '[|&;<>/]') and command not like 'timeout %')
select label, count(*) as calls, count(distinct (command, k)) as commands from u group by label"""

#: Global options that stand before a program's words.
_GLOBAL = {"git": "git -C /x --no-pager", "cargo": "cargo +nightly"}


@query
def c5_options(spark, sf_dir):
    """The corpus's commands with reviewed global options before their words: what the rules say of each."""
    calls = _commands(spark, sf_dir).where("command rlike '^(git|cargo) [^|&;<>]*$'").select("command").distinct()
    made = calls.select("command", F.expr(f"case when command like 'git %' then concat('{_GLOBAL['git']}', substring(command, 4)) else concat('{_GLOBAL['cargo']}', substring(command, 6)) end").alias("given"))
    chosen = selection.select_simple(selection.argv(made.select(F.col("given").alias("command"))), selection.rule_table(spark)).withColumnRenamed("command", "given")
    return made.join(chosen, "given").select("command", "given", "verdict", F.array_join("rule_ids", "+").alias("rules"))


ORACLES["c5_options"] = f"""
with s as ({ORACLES['c8_selection']})
select command, case when command like 'git %' then '{_GLOBAL['git']}' || substr(command, 4) else '{_GLOBAL['cargo']}' || substr(command, 6) end as given, verdict, rules from s where regexp_matches(command, '^(git|cargo) [^|&;<>]*$')"""


# Requests for a reduction, each a stream of one frame, answered by the rules and reducers.


@query
def s13_reduce_requests(spark, sf_dir):
    """Every result sent as a request of one frame (``frames.requests``), answered by rule and reducer (``pruning.pruned``): by what was done, how many and of how many bytes, and whether no answer is longer than its text."""
    rows = corpus(spark, sf_dir, f"select r.doc_id, result_key, output_text, {s.shell_command(SPARK, 'tool_name', 'input_format', 'input_text')} as command from tool_results r join tool_calls c on r.call_key = c.call_key", deal=True)
    message = F.to_json(F.struct(F.when(F.col("doc_id") % 13 == 0, 2).otherwise(1).alias("schemaVersion"), "command", F.col("output_text").alias("text"), (F.col("doc_id") % 3).alias("exitCode")))
    frame = frames.encode(message)
    content = F.when(F.col("doc_id") % 11 == 0, F.concat(frame, frame)).when(F.col("doc_id") % 17 == 0, F.expr("substring(f, 1, octet_length(f) - 1)")).otherwise(frame)
    asked = frames.requests(rows.withColumn("f", frame).select(F.col("result_key").alias("stream"), content.alias("content")))

    def answer(batches):
        for b in batches:
            out = []
            for command, text, ok, error in b[["command", "output_text", "succeeded", "error"]].itertuples(index=False):
                if error:
                    out.append((error, None, None))
                else:
                    found, left = pruning.pruned(command, text, ok)
                    out.append((found["verdict"], len(text.encode()), len(left)))
            yield pd.DataFrame(out, columns=["outcome", "bytes", "left"])

    told = asked.select("command", "output_text", "succeeded", "error").mapInPandas(answer, "outcome string, bytes long, left long")
    return told.groupBy("outcome").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.coalesce(F.bool_and(F.col("left") <= F.col("bytes")), F.lit(True)).alias("none_longer"))


ORACLES["s13_reduce_requests"] = f"""
with v as (select command, verdict from ({ORACLES['c20_choices']}) x),
r as (select * from (with {ctes(DUCK)} select r.doc_id, output_text, {_SHELL} as command from tool_results r join tool_calls c on r.call_key = c.call_key) y),
e as (select r.*, case when doc_id % 11 = 0 then 'trailing bytes' when doc_id % 17 = 0 then 'truncated frame' when doc_id % 13 = 0 then 'unsupported schema version' when command is null or output_text is null then 'incomplete request' end as error from r)
select coalesce(error, verdict) as outcome, count(*) as requests, cast(sum(case when error is null then strlen(output_text) end) as bigint) as bytes, true as none_longer from e left join v on e.command = v.command group by 1"""


@query
def a8_features(spark, sf_dir):
    """Results by the syntax labels of their commands (``shell.features``), a result under each; how many, of how many characters."""
    rows = corpus(spark, sf_dir, f"select length(output_text) as chars, {s.shell_command(SPARK, 'tool_name', 'input_format', 'input_text')} as command from tool_results r join tool_calls c on r.call_key = c.call_key").where("command is not null")
    labels = selection.choices(rows.select("command")).select("command", F.explode("syntax").alias("label"))
    return rows.join(labels, "command").groupBy("label").agg(F.count("*").alias("results"), F.sum("chars").cast("long").alias("chars"))


ORACLES["a8_features"] = f"""
with l as (select command, unnest(string_split(syntax, '+')) as label from ({ORACLES['c20_choices']}) x),
r as (select * from (with {ctes(DUCK)} select length(output_text) as chars, {_SHELL} as command from tool_results r join tool_calls c on r.call_key = c.call_key) y)
select label, count(*) as results, cast(sum(chars) as bigint) as chars from r join l on r.command = l.command group by label"""


@query
def r18_summaries(spark, sf_dir):
    """What every summary of every result says of its text (``reduce.summarise``, three families): its lines and diagnostic terms; and whether it keeps its budget."""
    rows = corpus(spark, sf_dir, "select result_key, output_text from tool_results", deal=True)

    def run(batches):
        policy = reduce.Policy()
        for b in batches:
            out = []
            for key, text in b.itertuples(index=False):
                for family in ("log", "test", "search"):
                    small = reduce.summarise(family, text.encode(), policy, False)
                    head = small.split(b"]", 1)[0].decode().removeprefix(f"[summary: {family}; source_lines=").split("; source_terms=")
                    out.append((key, family, int(head[0]), head[1] if len(head) > 1 else "", len(small) <= policy.output))
            yield pd.DataFrame(out, columns=["result_key", "family", "source_lines", "terms", "fits"])

    return rows.mapInPandas(run, "result_key string, family string, source_lines long, terms string, fits boolean")


_TERMS = " || ".join(f"case when contains(lower(output_text), '{t}') then ',{t}' else '' end" for t in s.DIAGNOSTIC_TERMS)
ORACLES["r18_summaries"] = f"""
with {ctes(DUCK)},
l as (select result_key, len(string_split(output_text, chr(10))) - case when output_text like '%' || chr(10) then 1 else 0 end as n, {_TERMS} as terms from tool_results)
select result_key, family, n as source_lines, substr(terms, 2) as terms, true as fits from l, (values ('log'), ('test'), ('search')) f(family)"""


@query
def q9_read_bytes(spark, sf_dir):
    """A range of bytes of every call's stored output (``archive.sources``, ``archive.read_bytes``), or why there is none."""
    rows = corpus(spark, sf_dir, "select call_key, output_text from first_results", deal=True)
    snaps = rows.select("call_key", F.lit("result_text").alias("subject"), F.lit("before").alias("stage"), F.lit("complete").alias("completeness"), F.encode("output_text", "UTF-8").alias("body"))
    found = archive.sources(*archive.store(snaps)).select("call_key", "body")

    def cut(batches):
        for b in batches:
            out = []
            for key, raw in b.itertuples(index=False):
                start = int(key) % 1000
                try:
                    out.append((key, archive.read_bytes(bytes(raw), start, start + 24).hex(), None))
                except ValueError as e:
                    out.append((key, None, str(e)))
            yield pd.DataFrame(out, columns=["call_key", "bytes", "error"])

    return found.mapInPandas(cut, "call_key string, bytes string, error string")


ORACLES["q9_read_bytes"] = f"""
with {ctes(DUCK)}
select call_key, case when strlen(output_text) >= doc_id % 1000 + 24 then lower(substr(hex(encode(output_text)), 2 * (doc_id % 1000) + 1, 48)) end as bytes,
  case when strlen(output_text) < doc_id % 1000 + 24 then 'range beyond the source' end as error from first_results"""


# Logs of three agents, written from the documents and read back by their adapters.

_HEADS = {
    "codex": "named_struct('type', 'session_meta', 'payload', named_struct('id', session))",
    "pi": "named_struct('type', 'session', 'version', 3, 'id', session)",
    "claude": "named_struct('type', 'summary', 'sessionId', session)",
}
_CALLS = {
    "codex": "named_struct('type', 'response_item', 'payload', named_struct('type', 'function_call', 'call_id', id, 'name', 'exec_command', 'arguments', concat('{\"cmd\":\"', lang, '\"}')))",
    "pi": "named_struct('type', 'message', 'id', concat('c', id), 'message', named_struct('role', 'assistant', 'content', array(named_struct('type', 'toolCall', 'id', id, 'name', 'bash', 'arguments', named_struct('command', lang)))))",
    "claude": "named_struct('type', 'assistant', 'sessionId', session, 'uuid', concat('c', id), 'message', named_struct('content', array(named_struct('type', 'tool_use', 'id', id, 'name', 'Bash', 'input', named_struct('command', lang)))))",
}
_RESULTS = {
    "codex": "named_struct('type', 'response_item', 'payload', named_struct('type', 'function_call_output', 'call_id', id, 'output', text))",
    "pi": "named_struct('type', 'message', 'id', concat('r', id), 'parentId', concat('c', id), 'message', named_struct('role', 'toolResult', 'toolCallId', id, 'isError', doc_id % 7 = 0, 'content', text))",
    "claude": "named_struct('type', 'user', 'sessionId', session, 'message', named_struct('content', array(named_struct('type', 'tool_result', 'tool_use_id', id, 'is_error', doc_id % 7 = 0, 'content', text))))",
}

#: Documents by their ids whose lines of a source are one file.
_PART = 1 << 20


def _kept(rows: DataFrame, path: str) -> DataFrame:
    """Rows that several joins read, written once."""
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query
def s6_agent_logs(spark, sf_dir):
    """Logs of three agents: every document a call and its result (some without the other, some results ahead of their calls), scanned, read, paired and merged (``jsonl``, ``agents``)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "cast(doc_id as string) as id", "coalesce(text, '') as text", "lang", "element_at(array('codex', 'pi', 'claude'), cast(doc_id % 3 + 1 as int)) as agent", "source")
    docs = docs.withColumn("session", F.concat_ws("/", "agent", "source")).withColumn("part", F.expr(f"doc_id div {_PART}"))
    line = lambda kinds: "case agent " + " ".join(f"when '{agent}' then to_json({made})" for agent, made in kinds.items()) + " end"
    call, result = f"case when doc_id % 83 <> 0 then {line(_CALLS)} end", f"case when doc_id % 89 <> 0 then {line(_RESULTS)} end"
    own = docs.selectExpr("agent", "session", "part", f"inline(array(struct(doc_id as n, 0 as k, {call} as value), struct(doc_id as n, if(doc_id % 10 = 4, -1, 1) as k, {result} as value)))").where("value is not null")
    heads = docs.where("agent is not null").select("agent", "session", "part").distinct().selectExpr("agent", "session", "part", "-1L as n", "0 as k", f"{line(_HEADS)} as value")
    file, folder = ("agent", "session", "part"), scratch(spark, "s6")
    heads.unionByName(own).repartition(*file).sortWithinPartitions(*file, "n", "k").select(*file, "value").write.partitionBy(*file).text(f"{folder}/logs")  # a file for each source and part
    paths, out = [r["path"] for r in jsonl.files(spark, f"{folder}/logs", "part-*.txt").select("path").collect()], None
    for agent in ("codex", "pi", "claude"):
        there = [p for p in paths if f"/agent={agent}/" in p]
        if not there:
            continue
        found = _kept(agents.read(jsonl.lines(jsonl.scan(spark, there)), agent), f"{folder}/events-{agent}")
        found = agents.sessions(found, few=len(there) <= agents.BROADCAST_KEYS)
        results = _kept(agents.paired(found, agents.calls(found, agent)), f"{folder}/results-{agent}")
        merged = agents.reconcile(results).select("call_key", F.col("is_error").alias("failed"), F.sha2(F.col("output_text"), 256).alias("digest"))
        told = results.select("session_id", "native_call_id", "issue", F.octet_length("output_text").cast("long").alias("bytes"), "call_key")
        told = told.join(merged, "call_key", "left").select(F.lit(agent).alias("agent"), "session_id", "native_call_id", "issue", "bytes", "failed", "digest")
        out = told if out is None else out.unionByName(told)
    return out if out is not None else spark.createDataFrame([], "agent string, session_id string, native_call_id string, issue string, bytes long, failed boolean, digest string")


ORACLES["s6_agent_logs"] = """
with d as (select doc_id, coalesce(text, '') as text, source, case doc_id % 3 when 0 then 'codex' when 1 then 'pi' else 'claude' end as agent from documents where doc_id % 89 <> 0)
select agent, agent || '/' || source as session_id, cast(doc_id as varchar) as native_call_id, case when doc_id % 83 = 0 then 'result_without_call' end as issue, strlen(text) as bytes,
  case when doc_id % 83 <> 0 and agent <> 'codex' then doc_id % 7 = 0 end as failed, case when doc_id % 83 <> 0 then sha256(text) end as digest from d"""


@query
def k7_commits(spark, sf_dir):
    """Calls and results committed in three versions (``store.commit``, ``store.merged``), read back: every key once, as its first version had it."""
    base = scratch(spark, "k7")
    calls, results = corpus(spark, sf_dir, "select call_key, doc_id, tool_name from tool_calls"), corpus(spark, sf_dir, "select result_key, call_key, length(output_text) as chars from tool_results")
    for turn in range(3):
        part = calls.where(F.col("doc_id") % 3 <= turn).select("call_key", F.lit(turn).alias("version"), "tool_name")
        store.commit(spark, base, lambda old, part=part, turn=turn: {"tool_calls": store.merged(old("tool_calls"), part, "call_key", ("version",)), **({"tool_results": results} if turn == 1 else {})})
    left = store.read(spark, base, "tool_results").groupBy("call_key").agg(F.sum("chars").alias("chars"))
    return store.read(spark, base, "tool_calls").join(left, "call_key", "left")


ORACLES["k7_commits"] = f"""
with {ctes(DUCK)}, r as (select call_key, cast(sum(length(output_text)) as bigint) as chars from tool_results group by call_key)
select c.call_key, doc_id % 3 as version, tool_name, chars from tool_calls c left join r on c.call_key = r.call_key"""
