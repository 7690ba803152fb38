"""Relational plans over the projected corpus: each function gives SQL for a dialect.

Text is scanned once and narrowed to lengths and flags before anything is shuffled; joins are equi-joins
on keys; no plan sorts more than it returns.
"""

from __future__ import annotations

from tallyloom.functions import scalars as s
from tallyloom.functions.dialect import Spark, pattern
from tallyloom.operators.classify import FAMILIES, line_class
from tallyloom.plans.corpus import ctes

PLANS: dict = {}


def plan(f):
    PLANS[f.__name__] = f
    return f


def over(d: Spark, *more: str) -> str:
    """A WITH clause of the corpus and more common table expressions."""
    return "with " + ",".join([ctes(d), *more])


# The measures of one result, next to the keys it is grouped by.
def measured(d: Spark) -> str:
    return f"""
measured as (select r.result_key, r.call_key, c.agent, c.tool_name, {s.size_band(d, "output_text")} as band,
  {s.succeeded(d, "is_error", "output_json")} as ok, length(output_text) as chars, {d.octets("output_text")} as bytes, {s.line_count("output_text")} as lines,
  {s.shell_command(d, "tool_name", "input_format", "input_text")} as command, {s.has_diagnostic(d, "output_text")} as diagnostic, output_text, output_json
  from tool_results r join tool_calls c on r.call_key = c.call_key)"""


@plan
def a6_census(d):
    """Results by size band and status, with characters, bytes and lines."""
    return f"""{over(d, measured(d))}
select band, case when ok then 'success' when not ok then 'failure' else 'unknown' end as status, count(*) as results,
  {d.long("sum(chars)")} as chars, {d.long("sum(bytes)")} as bytes, {d.long("sum(lines)")} as lines,
  {s.percent("sum(bytes) - sum(chars)", "sum(bytes)")} as extra_byte_percent from measured group by 1, 2"""


@plan
def a6_totals(d):
    """Totals of the pruning report that need no reducer."""
    return f"""{over(d, measured(d))}
select count(*) as evaluated, count(command) as shell, {d.count_if("ok is null")} as unknown_status, {d.count_if("diagnostic")} as with_diagnostics,
  {d.long("sum(chars)")} as chars, {d.long("sum(bytes)")} as bytes, {d.long("sum(lines)")} as lines, max(bytes) as largest from measured"""


@plan
def a7_breakdowns(d):
    """One pass over the measures, grouped by agent, tool, status and band apart."""
    return f"""{over(d, measured(d), '''m as (select agent, tool_name, coalesce(cast(ok as string), 'unknown') as status, band, chars, bytes from measured)''')}
select case when grouping(agent) = 0 then 'agent' when grouping(tool_name) = 0 then 'tool' when grouping(status) = 0 then 'status' else 'band' end as dimension,
  coalesce(agent, tool_name, status, band) as member, count(*) as results, {d.long("sum(chars)")} as chars, {d.long("sum(bytes)")} as bytes
from m group by grouping sets ((agent), (tool_name), (status), (band))"""


@plan
def a7_properties(d):
    """Results by property; a result counts under each of its labels."""
    labels = f"p as (select result_key, bytes, {s.result_properties(d, 'output_text', 'output_json')} as labels from measured)"
    return f"""{over(d, measured(d), labels)}
select label, count(*) as results, {d.long("sum(bytes)")} as bytes from {d.explode("p", "labels", "label")} x group by label"""


@plan
def a8_syntax_labels(d):
    """Lexical syntax labels of commands, with simple_command for none and mixed_syntax for several."""
    marks = {"and_list": "&&", "pipeline": "|", "sequence": ";", "redirection": ">", "parameter_expansion": "$"}
    found = d.compact(d.array(*[f"case when {d.rx('command', pattern([m]))} then '{n}' end" for n, m in marks.items()]))
    more = f"""f as (select result_key, chars, {found} as labels from measured where command is not null),
g as (select result_key, chars, case when {d.size("labels")} = 0 then {d.append("labels", "'simple_command'")} when {d.size("labels")} > 1 then {d.append("labels", "'mixed_syntax'")} else labels end as labels from f)"""
    return f"""{over(d, measured(d), more)}
select label, count(*) as results, {d.long("sum(chars)")} as chars from {d.explode("g", "labels", "label")} x group by label"""


@plan
def a9_ceiling(d):
    """Removable characters by command family under the budget, and conditional sums for the scenarios."""
    family = """case when command is null then 'not-shell' when program in ('cat', 'sed') then 'inspection/exact-text' when program = 'curl' then 'network/response'
  when program = 'jq' then 'structured-or-query-output' when program = 'echo' then 'shell/exact-small-output' when program = 'rm' then 'mutation/command'
  when program = 'python' then 'script/other' when program in ('ls', 'find', 'tree', 'df') then 'filesystem/' || program when program = 'ps' then 'system/ps'
  when program in ('make', 'ninja') then 'build/' || program else 'existing/' || program end"""
    more = f"""named as (select *, split_part(command, ' ', 1) as program from measured),
families as (select {family} as family, chars, bytes, ok, {s.budget_removal(d, "chars")} as removable from named)"""
    return f"""{over(d, measured(d), more)}
select family, count(*) as results, {d.long("sum(chars)")} as chars, {d.long("sum(removable)")} as removable, {d.count_if("removable > 0")} as affected,
  {d.long("sum(case when ok then removable else 0 end)")} as removable_success, {s.percent("sum(removable)", "sum(chars)")} as percent
from families group by family"""


@plan
def a1_stats(d):
    """Corpus totals as (measure, value): each table is read once, results and calls by key."""
    more = f"""r as (select call_key, count(*) as n, {d.count_if("is_error")} as errors, sum(length(output_text)) as chars, sum(coalesce(length(output_json), 0)) as structured from tool_results group by call_key),
c as (select c.call_key, length(c.input_text) as chars, r.n from tool_calls c left join r on r.call_key = c.call_key),
s as (select count(*) as sessions from sessions), i as (select sum(occurrence_count) as occurrences from import_issues),
rr as (select sum(n) as results, {d.count_if("n > 1")} as conflicting, sum(errors) as errors, sum(chars) as chars, sum(structured) as structured from r),
cc as (select count(*) as calls, {d.count_if("n is null")} as unanswered, sum(chars) as chars from c),
one as (select s.sessions, cc.calls, rr.results, cc.unanswered, rr.conflicting, rr.errors, i.occurrences, cc.chars as input_chars, rr.chars as output_chars, rr.structured from s cross join i cross join rr cross join cc)"""
    measures = {"sessions": "sessions", "calls": "calls", "results": "results", "calls_without_results": "unanswered", "conflicting_calls": "conflicting", "error_results": "errors", "issue_occurrences": "occurrences", "input_chars": "input_chars", "output_chars": "output_chars", "structured_chars": "structured"}
    return f"""{over(d, more)} select measure, value from (select measure, {d.long("coalesce(value, 0)")} as value from {d.unpivot("one", measures)} x) y"""


@plan
def a2_by_agent(d):
    """Seven measures by agent, each aggregated once and joined."""
    more = """s as (select agent, count(*) as sessions from sessions group by agent),
c as (select agent, count(*) as calls, sum(length(input_text)) as input_chars from tool_calls group by agent),
r as (select c.agent, count(*) as results, sum(case when r.is_error then 1 else 0 end) as errors, sum(length(r.output_text)) as output_chars,
  count(distinct r.call_key) as answered from tool_results r join tool_calls c on r.call_key = c.call_key group by c.agent)"""
    n = lambda x: d.long(f"coalesce({x}, 0)")
    return f"""{over(d, more)}
select s.agent, s.sessions, {n("calls")} as calls, {n("results")} as results, {n("errors")} as errors, {n("calls - answered")} as unanswered,
  {n("input_chars")} as input_chars, {n("output_chars")} as output_chars from s left join c on s.agent = c.agent left join r on s.agent = r.agent"""


@plan
def a3_conflicts(d):
    return f"{over(d)} select call_key, count(*) as variants from tool_results group by call_key having count(*) > 1"


@plan
def a4_verify(d):
    """Integrity counts and whether the corpus is valid."""
    more = """checks as (select 'orphan_calls' as check_name, count(*) as n from tool_calls c left join sessions s on c.session_key = s.session_key where s.session_key is null
union all select 'orphan_results', count(*) from tool_results r left join tool_calls c on r.call_key = c.call_key where c.call_key is null
union all select 'orphan_observations', count(*) from observations o left join tool_calls c on o.call_key = c.call_key left join tool_results r on o.result_key = r.result_key
  where (o.call_key is not null and c.call_key is null) or (o.result_key is not null and r.result_key is null)
union all select 'missing_results', count(*) from tool_calls c where not exists (select 1 from tool_results r where r.call_key = c.call_key)
union all select 'both_or_no_target', count(*) from observations where (call_key is null) = (result_key is null)
union all select 'conflicting_results', count(*) from (select call_key from tool_results group by call_key having count(*) > 1) x
union all select 'repeated_result_keys', count(*) from (select result_key from tool_results group by result_key having count(*) > 1) x
union all select 'error_issues', count(*) from import_issues where severity = 'error'
union all select 'unknown_issue_sources', count(*) from import_issues i where not exists (select 1 from observations o where o.source_item_key = i.source_item_key))"""
    return f"{over(d, more)} select check_name, n, n = 0 or check_name in ('missing_results', 'conflicting_results') as valid from checks"


@plan
def a5_issues(d):
    """The first thousand issues, errors first."""
    order = "severity desc, source_item_key asc nulls last, line_number asc nulls last, issue_key"
    return f"""{over(d, f"ranked as (select *, row_number() over (order by {order}) as place from (select * from import_issues order by {order} limit 1000) t)")}
select {d.long("place")} as place, severity, code, source_item_key, line_number, occurrence_count from ranked"""


@plan
def j3_flat_calls(d):
    """Calls with their result and observation counts; conflicting calls left out."""
    more = """variants as (select call_key, count(*) as n from tool_results group by call_key),
seen as (select call_key, count(*) as n from observations where call_key is not null group by call_key),
seen_results as (select result_key, count(*) as n from observations where result_key is not null group by result_key)"""
    return f"""{over(d, more)}
select c.call_key, c.agent, c.tool_name, r.result_key, r.is_error, length(r.output_text) as chars, coalesce(o.n, 0) as call_observations, coalesce(p.n, 0) as result_observations
from tool_calls c left join variants v on c.call_key = v.call_key left join tool_results r on c.call_key = r.call_key left join seen o on c.call_key = o.call_key
left join seen_results p on r.result_key = p.result_key where coalesce(v.n, 0) <= 1"""


@plan
def j5_unanswered(d):
    return f"{over(d)} select call_key, tool_name from tool_calls c where not exists (select 1 from tool_results r where r.call_key = c.call_key)"


@plan
def j6_orphans(d):
    return f"{over(d)} select r.result_key, r.call_key from tool_results r left join tool_calls c on r.call_key = c.call_key where c.call_key is null"


@plan
def j8_issue_sources(d):
    more = "items as (select distinct source_item_key from observations), roots as (select source_item_key, case when length(source_item_key) = 4 then 'a' else 'b' end as root from items)"
    return f"""{over(d, more)}
select i.issue_key, i.severity, r.root, t.source_item_key is not null as known from import_issues i left join items t on i.source_item_key = t.source_item_key
left join roots r on t.source_item_key = r.source_item_key"""


@plan
def k9_quarantine(d):
    """Orphan results whose observation directly follows a malformed line, once each."""
    more = """orphans as (select r.result_key from tool_results r left join tool_calls c on r.call_key = c.call_key where c.call_key is null),
bad as (select distinct source_item_key, line_number + 1 as line_number from import_issues where code = 'malformed_jsonl'),
hits as (select o.result_key, o.source_item_key, o.line_number, row_number() over (partition by o.result_key order by o.source_item_key, o.line_number) as n
  from observations o join orphans x on o.result_key = x.result_key join bad b on o.source_item_key = b.source_item_key and o.line_number = b.line_number)"""
    return f"{over(d, more)} select result_key, source_item_key, line_number, 'result_without_call' as code from hits where n = 1"


@plan
def j15_resolve_call(d):
    """A native id's call where it names one only: the latest, else none."""
    more = "ids as (select session_key, doc_id % 700 as native_id, call_key, doc_id % 1000 as called_at_ms from tool_calls)"
    return f"""{over(d, more)}
select session_key, native_id, count(*) as candidates, case when count(*) = 1 then max(call_key) end as call_key from ids group by session_key, native_id"""


@plan
def k2_merge_first_wins(d):
    """Staged rows join the stored ones: the first of each key by source order, none that is stored."""
    more = """stored as (select call_key from tool_calls where doc_id % 3 = 0),
staged as (select call_key, doc_id, 0 as batch, input_text from tool_calls where doc_id % 2 = 0 union all select call_key, doc_id, 1, input_text || '!' from tool_calls where doc_id % 5 = 0),
ranked as (select *, row_number() over (partition by call_key order by batch, doc_id) as n from staged)"""
    return f"""{over(d, more)}
select r.call_key, r.batch, length(r.input_text) as chars from ranked r where n = 1 and not exists (select 1 from stored s where s.call_key = r.call_key)"""


@plan
def k3_upsert_items(d):
    more = """old_items as (select distinct source_item_key, 1 as version from observations), new_items as (select source_item_key, 2 as version, max(line_number) as size from observations where line_number % 3 = 0 group by source_item_key)"""
    return f"""{over(d, more)}
select source_item_key, version, size from new_items union all
select o.source_item_key, o.version, cast(null as bigint) from old_items o where not exists (select 1 from new_items n where n.source_item_key = o.source_item_key)"""


@plan
def k5_reset_source(d):
    """Results and calls that no other source observed go with their source."""
    more = """gone_results as (select distinct result_key from observations where source_item_key = 'src3' and result_key is not null),
gone_calls as (select call_key from observations where source_item_key = 'src3' and call_key is not null union select r.call_key from tool_results r join gone_results g on r.result_key = g.result_key),
others as (select call_key, result_key from observations where source_item_key <> 'src3'),
kept_results as (select r.result_key, r.call_key from tool_results r where not exists (select 1 from gone_results g where g.result_key = r.result_key)
  or exists (select 1 from others o where o.result_key = r.result_key)),
kept_calls as (select c.call_key from tool_calls c where not exists (select 1 from gone_calls g where g.call_key = c.call_key)
  or exists (select 1 from others o where o.call_key = c.call_key) or exists (select 1 from kept_results k where k.call_key = c.call_key))"""
    return f"{over(d, more)} select 'result' as kind, result_key as id from kept_results union all select 'call', call_key from kept_calls"


@plan
def k6_replays(d):
    """Items that come again from their start with another checkpoint are to be reset."""
    more = """stored as (select source_item_key, max(line_number) as size, count(*) as lines from observations group by source_item_key),
incoming as (select source_item_key, max(line_number) as size, count(*) as lines from observations where line_number % 100 <> 7 group by source_item_key)"""
    return f"{over(d, more)} select i.source_item_key, s.size <> i.size or s.lines <> i.lines as must_reset from incoming i join stored s on i.source_item_key = s.source_item_key"


@plan
def k6_checkpoints(d):
    """What an import does with each source: nothing, go on where it was, or start again, and why: version, size, time, place, digest and status decide."""
    more = """stored as (select source_item_key, case when source_item_key = 'src7' then 1 else 2 end as version, max(line_number) as size, count(*) as modified, case when source_item_key = 'src8' then max(line_number) + 900 else max(line_number) end as imported,
  case when source_item_key <> 'src9' then sum(line_number * line_number) end as digest, case when source_item_key = 'src10' then 'rejected' else 'complete' end as status from observations group by source_item_key),
incoming as (select o.source_item_key, 2 as version, max(o.line_number) + case when o.source_item_key in ('src11', 'src12') then 40 else 0 end as size, count(*) + case when o.source_item_key = 'src13' then 1 else 0 end as modified,
  sum(case when o.line_number <= s.imported then o.line_number * o.line_number else 0 end) + case when o.source_item_key = 'src12' then 1 else 0 end as prefix from observations o join stored s on s.source_item_key = o.source_item_key group by o.source_item_key)"""
    return f"""{over(d, more)}
select i.source_item_key, case when s.version = i.version and s.size = i.size and s.modified = i.modified and s.imported = i.size and s.status = 'complete' then 'unchanged' when s.version <> i.version then 'reset: version'
    when s.imported > i.size then 'reset: shorter' when s.digest is null then 'reset: no digest' when s.digest <> i.prefix then 'reset: changed' else 'resume' end as decision,
  {d.long("case when s.version = i.version and s.imported <= i.size and s.digest = i.prefix then s.imported else 0 end")} as start_at from incoming i join stored s on s.source_item_key = i.source_item_key"""


@plan
def k8_size_check(d):
    """The estimated growth of an import against the limit: twice the payload and a kilobyte a row."""
    return f"""{over(d)}
select {d.long(f"sum({d.octets('output_text')} + coalesce({d.octets('output_json')}, 0)) * 2 + count(*) * 1024")} as growth,
  sum({d.octets("output_text")} + coalesce({d.octets("output_json")}, 0)) * 2 + count(*) * 1024 <= 10000000000 as fits from tool_results"""


@plan
def k11_payloads(d):
    """Payloads by digest, once each, with their length and the snapshots that refer to them."""
    return f"""{over(d)}
select {d.sha("output_text")} as sha256, max({d.octets("output_text")}) as bytes, count(*) as snapshots, min(result_key) as first_key from tool_results group by 1"""


@plan
def k12_snapshot_conflicts(d):
    """Snapshots staged more than once with different content or completeness."""
    more = f"""snaps as (select call_key, 'stdout' as subject, 'before' as stage, {d.sha("output_text")} as sha256, doc_id % 2 = 0 as complete from tool_results)"""
    return f"""{over(d, more)}
select call_key, subject, stage, count(*) as staged, count(distinct sha256) > 1 or count(distinct complete) > 1 as conflict from snaps group by call_key, subject, stage having count(*) > 1"""


@plan
def k14_sessions(d):
    """Sessions with the first start that is known, in the order in which calls came."""
    more = "starts as (select session_key, doc_id, case when doc_id % 4 <> 0 then (doc_id * 7919) % 100003 end as started_at_ms from tool_calls)"
    return f"{over(d, more)} select session_key, {d.min_by('started_at_ms', 'doc_id')} filter (where started_at_ms is not null) as started_at_ms, count(*) as calls from starts group by session_key"


@plan
def k15_archive_refs(d):
    """References of calls, the same for the same call, and whether its metadata agree."""
    more = """inserts as (select call_key, session_key, tool_name from tool_calls union all select call_key, session_key, tool_name || 'x' from tool_calls where doc_id % 101 = 0)"""
    return f"""{over(d, more)}
select call_key, 'yr_' || substring({d.sha("session_key || ' ' || call_key")}, 1, 32) as archive_ref, count(distinct tool_name) > 1 as conflict from inserts group by call_key, session_key"""


@plan
def k16_prune(d):
    """What is left when finished calls before a time go: payloads that a kept call still needs."""
    more = f"""snaps as (select r.call_key, {d.sha("output_text")} as sha256, c.doc_id < 300 and c.doc_id % 4 <> 0 as gone from tool_results r join tool_calls c on r.call_key = c.call_key)"""
    return f"{over(d, more)} select sha256, count(*) as snapshots from snaps where not gone group by sha256"


@plan
def keys_calls(d):
    """Session and call keys: SHA-256 over length-prefixed parts."""
    return f"""{over(d)}
select call_key as native_id, {s.key(d, "'session'", "'user'", "agent", "session_key")} as session_key, {s.key(d, "'call'", "'user'", "agent", "session_key", "call_key")} as call_key from tool_calls"""


@plan
def p1_shell_commands(d):
    return f"{over(d)} select call_key, {s.shell_command(d, 'tool_name', 'input_format', 'input_text')} as command from tool_calls"


@plan
def p2_outcomes(d):
    return f"{over(d)} select result_key, is_error, {s.succeeded(d, 'is_error', 'output_json')} as succeeded from tool_results"


@plan
def p4_bands_and_lengths(d):
    return f"""{over(d)}
select result_key, {s.size_band(d, "output_text")} as band, {s.line_count("output_text")} as lines, length(output_text) as chars, {d.octets("output_text")} as bytes,
  {s.has_diagnostic(d, "output_text")} as diagnostic, {d.longest_line("output_text")} as longest from tool_results"""


@plan
def p10_lost_diagnostics(d):
    """Diagnostic terms that a text has and its first 200 characters have not."""
    cut = d.sub("output_text", "1", "200")
    lost = d.compact(d.array(*[f"case when {d.rx('output_text', pattern([t], 'c', True))} and not {d.rx(cut, pattern([t], 'c', True))} then '{t}' end" for t in s.DIAGNOSTIC_TERMS]))
    return f"{over(d, f'l as (select result_key, {lost} as lost from tool_results)')} select result_key, term from {d.explode('l', 'lost', 'term')} x"


@plan
def p12_budget(d):
    return f"{over(d)} select result_key, length(output_text) as chars, {s.budget_removal(d, 'length(output_text)')} as removed from tool_results"


REF = "yr_" + "0123456789abcdef" * 2


@plan
def p11_recovery_markers(d):
    """Texts that name an archived original, and those that also say how to search it."""
    marked = f"""m as (select result_key, output_text || case when doc_id % 7 = 0 then ' ref={REF};' else '' end || case when doc_id % 3 = 0 then ' search {REF} x' else '' end
  || case when doc_id % 5 = 0 then ' search it' else '' end as body from tool_results)"""
    return f"{over(d, marked)} select result_key, body like '%{REF}%' as named, {s.recovery_marker('body', chr(39) + REF + chr(39))} as marked from m"


@plan
def p27_completeness(d):
    """What the host says of each result: its exit code and whether its output is whole."""
    return f"""{over(d)}
select result_key, {s.exit_code(d, "output_json")} as exit_code, {s.completeness(d, "output_json", "doc_id % 13 = 0")} as completeness, {s.host_truncated(d, "output_json")} as host_truncated from tool_results"""


@plan
def c18_recovery_commands(d):
    """Commands that search or read the archive itself, which no rule may touch."""
    asked = """r as (select call_key, case doc_id % 5 when 0 then 'keep search ' || call_key || ' error' when 1 then 'keep read ' || call_key || ' --help' when 2 then 'keep list' when 3 then 'keep read' else input_text end as command from tool_calls)"""
    return f"{over(d, asked)} select call_key, {s.recovery_command(d, 'command', 'keep')} as recovery from r"


@plan
def k10_import_runs(d):
    """Runs when the next one opens: those still running failed then; the last that finished gives an agent's state."""
    runs = """runs as (select session_key as run_key, agent, min(doc_id) as started, max(doc_id) as last, count(*) as n from all_calls group by session_key, agent),
ended as (select run_key, agent, started, case when n % 3 = 0 then 'running' when n % 3 = 1 then 'complete' else 'failed' end as status, case when n % 3 <> 0 then last end as finished from runs),
opened as (select *, (select max(last) + 1 from runs) as now from ended)"""
    return f"""{over(d, runs)} select run_key, agent, {d.long("started")} as started_at, case when status = 'running' then 'failed' else status end as status,
  {d.long("case when status = 'running' then now else finished end")} as finished_at, row_number() over (partition by agent order by coalesce(finished, now) desc, run_key) = 1 as latest from opened"""


@plan
def j13_reference_collisions(d):
    """Calls whose reference an earlier call has: all but the first of each reference are to be drawn anew."""
    refs = "r as (select call_key, doc_id, 'yr_' || cast(doc_id % 137 as string) as archive_ref from tool_calls)"
    return f"""{over(d, refs)} select call_key, archive_ref, {d.long("n")} as place from (select call_key, archive_ref, row_number() over (partition by archive_ref order by doc_id, call_key) as n from r) x where n > 1"""


@plan
def r24_fingerprints(d):
    """Texts that are the same bytes: by digest and length, with how often."""
    return f"{over(d)} select {d.sha('output_text')} as digest, {d.octets('output_text')} as bytes, count(*) as results from tool_results group by 1, 2 having count(*) > 1"


@plan
def p20_line_filter(d):
    """Lines kept by a filter: dropped patterns win, no kept patterns keep all."""
    more = f"l as (select * from {d.lines('tool_results', 'result_key', 'output_text')} x)"
    keep, drop = d.rx("line", pattern(["error", "warning", "the"], "c", True)), f"trim(line) like '%well' or {d.rx('line', pattern(['The '], 'p'))}"
    return f"{over(d, more)} select result_key, count(*) as lines, {d.count_if(f'({keep}) and not ({drop})')} as kept from l group by result_key"


@plan
def p22_setup_diagnostics(d):
    return f"{over(d)} select result_key, {d.rx('output_text', pattern(list(s.SETUP_DIAGNOSTICS), 'c', True))} as setup from tool_results"


@plan
def p28_ceiling_flags(d):
    return f"""{over(d)}
select {d.count_if(s.has_diagnostic(d, "output_text"))} as diagnostics, {d.count_if(d.octets("output_text") + " > length(output_text)")} as non_ascii,
  {d.count_if("output_text like '%' || chr(0) || '%'")} as nul, {d.count_if(d.longest_line("output_text") + " > 1048576")} as oversized from tool_results"""


@plan
def r3_line_classes(d):
    """Lines by reducer family and class: texts are split once, each line is classified by every family in one row."""
    lines = f"l as (select * from {d.lines('tool_results', 'result_key', 'output_text')} x)"
    classes = ", ".join(f"{line_class(d, f, 'line')} as {f}" for f in FAMILIES)
    return f"""{over(d, lines, f"c as (select {classes} from l)")} select family, class, count(*) as lines from {d.unpivot("c", {f: f for f in FAMILIES}, "family", "class")} x group by family, class"""


@plan
def r11_context(d):
    """Lines promoted to context: the six after a diagnostic that are noise or examples."""
    more = f"""l as (select result_key, line_no, {line_class(d, "log", "line")} as class from {d.lines("tool_results", "result_key", "output_text")} x),
w as (select *, max(case when class = 'diagnostic' then line_no end) over (partition by result_key order by line_no rows between unbounded preceding and 1 preceding) as last from l)"""
    return f"""{over(d, more)}
select result_key, {d.count_if("class = 'diagnostic'")} as diagnostics, {d.long("sum(case when class in ('noise', 'example') and line_no - last <= 6 then 1 else 0 end)")} as context from w group by result_key"""


@plan
def r14_first_examples(d):
    """The first line for each diversity key of a result: before a colon (search, build), before dots (test), the first folder of the last word (list)."""
    last = "regexp_replace(line, '^.*[ ]', '')"
    more = f"""l as (select * from {d.lines("tool_results", "result_key", "output_text")} x),
k as (select result_key, line_no, split_part(line, ':', 1) as before_colon, split_part(line, '...', 1) as before_dots, case when {last} like '%/%' then split_part({last}, '/', 1) else '' end as folder from l),
u as (select result_key, line_no, kind, diversity from {d.unpivot("k", {"colon": "before_colon", "dots": "before_dots", "folder": "folder"}, "kind", "diversity", "result_key, line_no, ")} x),
f as (select result_key, kind, diversity, min(line_no) as line_no from u where diversity <> '' and {d.octets("diversity")} <= 128 group by result_key, kind, diversity)"""
    return f"{over(d, more)} select result_key, kind, count(*) as examples, {d.long('sum(line_no)')} as places from f group by result_key, kind"


@plan
def r20_savings_gate(d):
    """Whether a text of half the bytes would replace the raw one."""
    n = d.octets("output_text")
    half = d.div(n, "2")
    return f"""{over(d, f"g as (select result_key, {n} as raw, {half} as small from tool_results)")}
select result_key, case when raw > 704 then true when small >= raw or raw - small < 256 or (raw - small) * 10000 < raw * 1500 then false else true end as reduced from g"""


@plan
def q2_search(d):
    """Matching lines of each text, word bounds in ASCII."""
    word = "(?<![A-Za-z0-9_])(?:the|error)(?![A-Za-z0-9_])" if d.name == "spark" else r"\b(?:the|error)\b"
    more = f"l as (select * from {d.lines('tool_results', 'result_key', 'output_text')} x)"
    return f"{over(d, more)} select result_key, count(*) as matches, min(line_no) as first, max(line_no) as last from l where {d.rx('line', word)} group by result_key"


@plan
def w4_context_groups(d):
    """Matches with two lines before and after; ranges that touch are one group."""
    more = f"""l as (select result_key, line_no, {d.rx("line", pattern(["error", "warning", "tion the"]))} as hit from {d.lines("tool_results", "result_key", "output_text")} x),
c as (select *, max(case when hit then 1 else 0 end) over (partition by result_key order by line_no rows between 2 preceding and 2 following) as shown from l),
s as (select result_key, line_no, hit, line_no - row_number() over (partition by result_key order by line_no) as island from c where shown = 1)"""
    return f"{over(d, more)} select result_key, min(line_no) as from_line, max(line_no) as to_line, {d.count_if('hit')} as hits from s group by result_key, island"


@plan
def o4_first_matches(d):
    """The first 20 matching lines of each text: the search's own limit."""
    more = f"""l as (select result_key, line_no, line from {d.lines("tool_results", "result_key", "output_text")} x where {d.rx("line", pattern([" in "]))}),
n as (select *, row_number() over (partition by result_key order by line_no) as place from l)"""
    return f"{over(d, more)} select result_key, {d.long('line_no')} as line_no, length(line) as chars from n where place <= 20"


@plan
def q8_read_lines(d):
    """Lines 2 to 4 of each text."""
    more = f"l as (select * from {d.lines('tool_results', 'result_key', 'output_text')} x)"
    return f"{over(d, more)} select result_key, {d.long('line_no')} as line_no, line from l where line_no between 2 and 4"


@plan
def a11_archive_stats(d):
    """Counts, bytes and distinct payloads of the archive."""
    more = f"""p as (select {d.sha("output_text")} as sha256, max({d.octets("output_text")}) as bytes, count(*) as n from tool_results group by 1)"""
    return f"{over(d, more)} select count(*) as payloads, {d.long('sum(n)')} as snapshots, {d.long('sum(bytes)')} as stored_bytes, {d.long('sum(bytes * n)')} as referred_bytes, max(n) as most_shared from p"


@plan
def a12_archive_verify(d):
    """Failed checks of the archive with their counts: values of calls, snapshots and payloads, and that each refers to one that is there."""
    more = f"""calls as (select call_key, session_key, case when doc_id % 307 = 0 then 'paused' when doc_id % 3 = 0 then 'open' else 'finished' end as status, 'yr_' || substring({d.sha("call_key")}, 1, case when doc_id % 401 = 0 then 30 else 32 end) as archive_ref,
  case when doc_id % 3 <> 0 or doc_id % 311 = 0 then doc_id + 5 end as finished_at, doc_id as started_at from tool_calls where doc_id % 293 <> 0),
snaps as (select call_key, case when doc_id % 211 = 0 then 'other' else 'stdout' end as subject, case when doc_id % 223 = 0 then 'during' else 'before' end as stage, case when doc_id % 227 = 0 then 'half' when doc_id % 2 = 0 then 'complete' else 'unknown' end as completeness,
  {d.sha("output_text")} as sha256 from tool_results),
payloads as (select {d.sha("output_text")} as sha256, max({d.octets("output_text")}) as bytes, max(case when doc_id % 229 = 0 then 1 else 0 end) as off, max(case when doc_id % 233 = 0 then 'brotli' else 'zstd' end) as codec from tool_results where length(call_key) <> 2 group by 1),
found as (select 'call status' as problem, count(*) as n from calls where status not in ('open', 'finished')
union all select 'call reference', count(*) from calls where length(archive_ref) <> 35
union all select 'open call with an end', count(*) from calls where status = 'open' and finished_at is not null
union all select 'finished call without an end', count(*) from calls where status = 'finished' and finished_at is null
union all select 'call that ends before it starts', count(*) from calls where finished_at < started_at
union all select 'call without session', count(*) from calls c left join sessions s on c.session_key = s.session_key where s.session_key is null
union all select 'repeated reference', count(*) from (select archive_ref from calls group by archive_ref having count(*) > 1) x
union all select 'snapshot subject', count(*) from snaps where subject not in ('input', 'result', 'result_text', 'source_output', 'stdout', 'stderr')
union all select 'snapshot stage', count(*) from snaps where stage not in ('before', 'after', 'final')
union all select 'snapshot completeness', count(*) from snaps where completeness not in ('complete', 'incomplete', 'unknown')
union all select 'snapshot without call', count(*) from snaps s where not exists (select 1 from calls c where c.call_key = s.call_key)
union all select 'snapshot without payload', count(*) from snaps s where not exists (select 1 from payloads p where p.sha256 = s.sha256)
union all select 'payload without snapshot', count(*) from payloads p where not exists (select 1 from snaps s where s.sha256 = p.sha256)
union all select 'payload length', count(*) from payloads p where bytes + off <> bytes
union all select 'payload codec', count(*) from payloads where codec not in ('none', 'zstd'))"""
    return f"{over(d, more)} select problem, n from found where n > 0"


@plan
def w5_turn_pairs(d):
    """Calls and results of conversations by position: the n-th user turn against the n-th answer."""
    return f"""with u as (select conv_id, text, row_number() over (partition by conv_id order by turn) as n from conversations where role = 'user'),
a as (select conv_id, text, row_number() over (partition by conv_id order by turn) as n from conversations where role = 'assistant')
select coalesce(u.conv_id, a.conv_id) as conv_id, {d.long("coalesce(u.n, a.n)")} as place, u.n is not null and a.n is not null as paired,
  coalesce(length(u.text), 0) as asked, coalesce(length(a.text), 0) as answered from u full outer join a on u.conv_id = a.conv_id and u.n = a.n"""


@plan
def s11_event_sessions(d):
    """Event sessions by user with gaps of an hour, from the ordered log."""
    more = f"""e as (select user_id, event_id, {d.micros("ts")} as us from events),
g as (select *, case when us - lag(us) over (partition by user_id order by us, event_id) <= 3600000000 then 0 else 1 end as fresh from e),
s as (select *, sum(fresh) over (partition by user_id order by us, event_id rows between unbounded preceding and current row) as session from g)"""
    return f"with {more} select user_id, {d.long('session')} as session, count(*) as n_events, min(us) as first_us, max(us) as last_us from s group by user_id, session"
