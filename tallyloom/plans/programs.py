"""Queries whose core is a program rather than SQL: selection, reduction, archive, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars as s
from tallyloom.functions.dialect import DUCK, SPARK
from tallyloom.operators import archive, pruning, reduce, rule_data, search, selection, taxonomy
from tallyloom.operators.shell import FEATURES
from tallyloom.plans.corpus import ctes
from tallyloom.streaming import frames, ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def corpus(spark: SparkSession, sf_dir: str, select: str, deal: bool = False) -> DataFrame:
    from tallyloom.plans.registry import run_plan

    return run_plan(spark, sf_dir, lambda d: f"with {ctes(d)} {select}", deal)


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, f"select call_key, {s.shell_command(SPARK, 'tool_name', 'input_format', 'input_text')} as command from tool_calls").where("command is not null")


@query
def c8_selection(spark, sf_dir):
    """The verdict on each distinct command, by the rule join, with how many calls gave it."""
    calls = _commands(spark, sf_dir)
    n = calls.groupBy("command").agg(F.count("*").alias("calls"))
    chosen = selection.select_simple(selection.argv(calls), selection.rule_table(spark))
    return n.join(chosen, "command").select("command", "calls", "verdict", F.array_join("rule_ids", "+").alias("rules"), "reducer")


def _rules_values() -> str:
    q = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::varchar[]"
    return ", ".join(
        f"('{p}', '{r['id']}', '{r['action']}', {repr(r['reducer']) if r['reducer'] else 'null'}, {q(r['argv_prefix'])}, {q(r['contains'])})" for r in rule_data.rules() for p in r["programs"]
    )


ORACLES["c8_selection"] = f"""
with {ctes(DUCK)},
rules(program, rule_id, action, reducer, prefix, needed) as (values {_rules_values()}),
c as (select {s.shell_command(DUCK, "tool_name", "input_format", "input_text")} as command, count(*) as calls from tool_calls group by 1 having command is not null),
a as (select *, string_split(command, ' ') as argv, string_split(command, ' ')[2:] as tail from c),
h as (select command, rule_id, action, reducer from a join rules on not regexp_matches(command, '[|&;<>]') and argv[1] = program and tail[1:len(prefix)] = prefix
  and len(list_filter(needed, lambda q: len(list_filter(tail, lambda w: w = q or (q like '--%' and starts_with(w, q || '='))
    or (length(q) = 2 and q like '-%' and q <> '--' and length(w) > 2 and w like '-%' and w not like '--%' and contains(w[2:], q[2:2])))) > 0)) = len(needed)),
g as (select command, count(*) filter (where action = 'passthrough') as guards, count(*) filter (where action <> 'passthrough') as others,
  string_agg(rule_id, '+' order by rule_id) filter (where action = 'passthrough') as guard_ids, string_agg(rule_id, '+' order by rule_id) filter (where action <> 'passthrough') as other_ids,
  max(action) as action, max(reducer) as reducer from h group by command)
select command, calls, case when regexp_matches(command, '[|&;<>]') then 'parse_error' when guards > 0 then 'passthrough' when others > 1 then 'ambiguous' else coalesce(action, 'unsupported') end as verdict,
  coalesce(case when guards > 0 then guard_ids else other_ids end, '') as rules, case when guards = 0 and others = 1 then reducer end as reducer
from c left join g using (command)"""


@query
def c4_features(spark, sf_dir):
    """Syntax labels of distinct commands that are joined from the corpus's commands."""
    calls = _commands(spark, sf_dir).select(F.concat_ws(" && ", "command", F.concat(F.lit("cd x; "), "command")).alias("command"))
    n = calls.groupBy("command").agg(F.count("*").alias("calls"))
    return n.join(selection.syntax(calls), "command").select("command", "calls", F.array_join("labels", "+").alias("labels"))


def _feature_values() -> str:
    """By hand: a command's own labels (``_SYNTAX``), and those of the list that it is put in."""
    own = lambda c: set(_SYNTAX.get(c, "").split("+")) | {"and_list", "sequence"}
    return ", ".join(f"('{c}', '{'+'.join(f for f in FEATURES if f in own(c))}')" for c, *_ in _CHOICES)


def _features_oracle() -> str:
    return f"""
with {ctes(DUCK)},
c as (select {s.shell_command(DUCK, "tool_name", "input_format", "input_text")} as command, count(*) as calls from tool_calls group by 1 having command is not null),
k(command, labels) as (values {_feature_values()})
select command || ' && cd x; ' || command as command, calls, labels from c left join k using (command)"""


@query
def c12_plans(spark, sf_dir):
    """Plans for compound commands made from the corpus's commands and pairs of neighbours in a session."""
    shell = s.shell_command(SPARK, "tool_name", "input_format", "input_text")
    calls = corpus(spark, sf_dir, f"select session_key, call_key, doc_id, {shell} as command from tool_calls").where("command is not null")
    pairs = calls.withColumn("next", F.expr("lead(command) over (partition by session_key order by doc_id, call_key, command)"))
    piped = calls.select(F.concat(F.lit("cd x && "), "command", F.lit(" 2>&1 | tail -5")).alias("command"))
    rows = piped.unionAll(pairs.where("next is not null").select(F.concat("command", F.lit("; "), "next").alias("command")))
    return selection.plans(rows).select("command", "reducer", "confidence", F.array_join("transforms", "+").alias("transforms"), "setup_text", "refused")


def _reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result with its labels and what the reducers leave of it: the texts are read once and go no further."""
    select = f"""select r.result_key, c.agent, c.tool_name, {s.shell_command(SPARK, 'tool_name', 'input_format', 'input_text')} as command,
      {s.succeeded(SPARK, 'is_error', 'output_json')} as succeeded, {s.size_band(SPARK, 'output_text')} as band, {s.result_properties(SPARK, 'output_text', 'output_json')} as properties,
      {s.has_diagnostic(SPARK, 'output_text')} as diagnostic, output_text like '%' || chr(0) || '%' as nul, {s.budget_removal(SPARK, 'length(output_text)')} as removable, output_text
      from tool_results r join tool_calls c on r.call_key = c.call_key join sessions s on s.session_key = c.session_key"""
    status = F.when(F.col("succeeded"), "success").when(~F.col("succeeded"), "failure").otherwise("unknown")
    return pruning.prune(corpus(spark, sf_dir, select, deal=True)).withColumn("status", status)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, 6))


@query
def a6_pruning(spark, sf_dir):
    """Totals of the pruning report over all results, in one pass; vetoes by term as one text."""
    own, shell = F.col("verdict") == "reduce", F.col("verdict").isNotNull()
    total = lambda c, which=own: F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0))
    vetoes = F.concat_ws(",", *[F.concat(F.lit(f"{t}="), F.count_if(own & F.array_contains("lost_terms", t)).cast("string")) for t in s.DIAGNOSTIC_TERMS])
    r = _reduced(spark, sf_dir).agg(
        F.count("*").alias("evaluated"), F.sum("chars").alias("evaluated_chars"), F.count_if(shell).alias("shell"), total("chars", shell).alias("shell_chars"), F.count_if(own).alias("eligible"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("passthrough", "ambiguous", "unsupported")],
        F.count_if(own & (F.col("status") == "unknown")).alias("unknown_status"), F.count_if(own & F.col("changed")).alias("affected"),
        *[total(c).alias(c) for c in ("chars", "pruned_chars", "bytes", "pruned_bytes", "lines", "pruned_lines")],
        F.count_if(own & (F.size("lost_terms") > 0)).alias("vetoes"), vetoes.alias("vetoes_by_term"), F.count_if(own & F.col("changed") & ~F.col("marked")).alias("missing_markers"),
    )
    removed = F.col("chars") - F.col("pruned_chars")
    return r.select(
        "*", removed.alias("removed_chars"), (F.col("bytes") - F.col("pruned_bytes")).alias("removed_bytes"), F.greatest(F.col("lines") - F.col("pruned_lines"), F.lit(0)).alias("removed_lines"),
        _share(F.col("affected"), F.col("eligible")).alias("affected_percent"), _share(removed, F.col("chars")).alias("removed_percent"),
        _share(removed, F.col("shell_chars")).alias("removed_percent_of_shell"), _share(removed, F.col("evaluated_chars")).alias("removed_percent_of_all"),
    )


@query
def a7_pruning_breakdowns(spark, sf_dir):
    """Twelve measures of the results that a rule reduces, in nine breakdowns. A result counts under each of its syntax labels and properties."""
    label = lambda dimension, *members: F.transform(F.array_compact(F.array(*members)), lambda m: F.struct(F.lit(dimension).alias("dimension"), m.alias("member")))
    each = lambda dimension, members, f=lambda m: m: F.transform(members, lambda m: F.struct(F.lit(dimension).alias("dimension"), f(m).alias("member")))
    single = [label(d, F.col(c)) for d, c in (("agent", "agent"), ("tool", "tool_name"), ("rule", "rule"), ("reducer", "reducer"), ("status", "status"), ("band", "band"))]
    many = [each("syntax", F.col("syntax")), each("syntax and status", F.col("syntax"), lambda m: F.concat_ws("/", m, "status")), each("property", F.col("properties"))]
    r = _reduced(spark, sf_dir).where("verdict = 'reduce'").withColumn("under", F.explode(F.concat(*single, *many)))
    out = r.groupBy("under.dimension", "under.member").agg(
        F.count("*").alias("results"), F.count_if(F.col("changed")).alias("affected"), *[F.sum(c).alias(c) for c in ("chars", "pruned_chars")], F.sum(F.expr("chars - pruned_chars")).alias("removed_chars"),
        F.max("chars").alias("largest"), F.max(F.expr("chars - pruned_chars")).alias("most_removed"), *[F.sum(c).alias(c) for c in ("bytes", "pruned_bytes")], F.sum(F.expr("bytes - pruned_bytes")).alias("removed_bytes"),
        *[F.sum(c).alias(c) for c in ("lines", "pruned_lines")],
    )
    return out


def _unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir).where("verdict is not null and not changed")


@query
def a9_ceiling_families(spark, sf_dir):
    """What is left as it is, by family: thirteen measures, the most removable first."""
    has = lambda p: F.count_if(F.array_contains("properties", p))
    out = _unchanged(spark, sf_dir).groupBy("family", "kind", "suggested").agg(
        F.count("*").alias("results"), F.sum("chars").alias("chars"), F.sum("lines").alias("lines"), F.max("chars").alias("largest"), *[F.count_if(F.col("status") == v).alias(v) for v in ("success", "failure", "unknown")],
        F.count_if(F.col("diagnostic")).alias("diagnostics"), has("non_ascii").alias("non_ascii"), F.count_if(F.col("nul")).alias("nul"), has("oversized_line_1m").alias("oversized"), F.count_if(F.col("removable") > 0).alias("eligible"), F.sum("removable").alias("removable"),
    )
    return out.orderBy(F.desc("removable"), "family")


@query
def a9_ceiling_totals(spark, sf_dir):
    """Totals of the ceiling, and what three scenarios would add: families under review, those and unclear ones, all that is unchanged."""
    r = _reduced(spark, sf_dir).withColumn("left", F.expr("verdict is not null and not changed"))
    shell, cut = F.col("verdict").isNotNull(), F.col("changed")
    total = lambda which, c="chars": F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0))
    gone = F.coalesce(F.sum(F.when(cut, F.col("chars") - F.col("pruned_chars"))), F.lit(0))
    kinds = {"review": ("review_candidate",), "review_and_unclear": ("review_candidate", "unclear"), "unchanged": ("review_candidate", "unclear", "existing_rule", "required_pass_through")}
    more = []
    for name, which in kinds.items():
        own = F.col("left") & F.col("kind").isin(*which)
        more += [F.count_if(own & (F.col("removable") > 0)).alias(f"{name}_results"), total(own, "removable").alias(f"{name}_chars")]
    t = r.agg(
        F.count("*").alias("evaluated"), F.sum("chars").alias("evaluated_chars"), F.count_if(shell).alias("shell"), total(shell).alias("shell_chars"), F.count_if(cut).alias("changed"), gone.alias("removed_chars"),
        F.count_if(F.col("left")).alias("left_results"), total(F.col("left")).alias("left_chars"), *more,
    )
    after = lambda n: F.col("removed_chars") + F.col(f"{n}_chars")
    shares = [x for n in kinds for x in ((F.col("changed") + F.col(f"{n}_results")).alias(f"{n}_changed"), _share(after(n), F.col("shell_chars")).alias(f"{n}_percent_of_shell"), _share(after(n), F.col("evaluated_chars")).alias(f"{n}_percent_of_all"))]
    return t.select("*", *shares)


@query
def a9_ceiling_syntax(spark, sf_dir):
    """Shell results by the syntax of their command and what a budget would remove, the largest first; the command's own labels only."""
    r = _reduced(spark, sf_dir).where("verdict is not null").withColumn("label", F.explode("syntax")).where("label not in ('simple_command', 'mixed_syntax')")
    out = r.groupBy("label").agg(F.count("*").alias("results"), F.sum("chars").alias("chars"), F.count_if(F.col("removable") > 0).alias("eligible"), F.sum("removable").alias("removable"))
    return out.orderBy(F.desc("chars"), "label")


#: What is to become of the corpus's commands, by hand: (command, verdict, rule, confidence, family of its unchanged results, kind); None: as usual.
_CHOICES = [
    ("rg needle src", "reduce", "builtin/search/rg"), ("grep -rn error logs", "reduce", "builtin/search/grep"), ("git status", "reduce", "builtin/git/status"), ("git diff HEAD~1", "reduce", "builtin/git/diff"),
    ("git log --oneline -5", "reduce", "builtin/git/log-oneline"), ("cargo test --all", "reduce", "builtin/rust/cargo-test"), ("cargo build", "reduce", "builtin/rust/cargo-build"), ("pytest -q tests", "reduce", "builtin/python/pytest"),
    ("npm run build", "reduce", "builtin/js/run-build"), ("pnpm lint", "reduce", "builtin/js/lint-alias"), ("ls -la", "reduce", "builtin/filesystem/ls"), ("find . -name x", "reduce", "builtin/filesystem/find"),
    ("git status --porcelain", "passthrough", "guarded/builtin/guards/git-porcelain+builtin/guards/git-status-porcelain"), ("rg --json needle", "passthrough", "guarded/builtin/guards/rg-json"),
    ("cargo test --message-format json", "passthrough", "guarded/builtin/guards/cargo-message-format"), ("docker logs web", "reduce", "builtin/ops/docker-logs"), ("kubectl get pods", "reduce", "builtin/ops/kubectl-get"),
    ("kubectl get pods -o yaml", "passthrough", "guarded/builtin/guards/kubectl-output-short"), ("journalctl -u web", "reduce", "builtin/ops/journalctl"), ("systemctl status web", "reduce", "builtin/ops/systemctl-status"),
    ("cat notes.txt", "unsupported", "inspection/exact-text"), ("sed -n 1p notes.txt", "unsupported", "inspection/exact-text"), ("python run.py", "unsupported", "script/other"), ("curl -s host/path", "unsupported", "network/response"),
    ("jq .name data.json", "unsupported", "structured-or-query-output"), ("make test", "reduce", "builtin/build/task-test"), ("ninja", "reduce", "builtin/build/ninja"), ("git grep -n word", "reduce", "builtin/search/git-grep"),
    ("gh pr list", "reduce", "builtin/gh/pr-list"), ("gh pr list --json id", "passthrough", "guarded/builtin/guards/gh-json"), ("tsc -p .", "reduce", "builtin/js/tsc"), ("eslint .", "reduce", "builtin/js/eslint"),
    ("uv run pytest", "reduce", "builtin/python/uv-pytest"), ("go test ./...", "reduce", "builtin/go/test"), ("ps aux", "reduce", "builtin/system/ps-aux"), ("df -h", "reduce", "builtin/filesystem/df"),
    ("echo done", "unsupported", "shell/exact-small-output"), ("rm -rf build", "unsupported", "mutation/command"), ("codex exec review", "reduce", "builtin/reviews/codex-review"), ("tree -J src", "passthrough", "guarded/builtin/guards/tree-json"),
    ("cd src && cargo test --all", "reduce", "compound/test_summary"), ("rg needle | head -5", "reduce", "compound/search_summary"), ("FOO=1 make test", "reduce", "compound/test_summary"), ("timeout 60 pytest -q", "reduce", "compound/test_summary"),
    ("set -o pipefail && rg needle | tail -3", "reduce", "compound/search_summary"), ("cargo build || cargo test", "unsupported", "shell/unsupported-syntax"), ("cargo test && git status", "unsupported", "shell/unsupported-syntax"),
    ("git log -1; git status", "unsupported", "shell/unsupported-syntax"), ("cat notes.txt | wc -l", "unsupported", "shell/unsupported-syntax"), ("git status > out.txt", "unsupported", "shell/unsupported-syntax"),
    ("for f in a b; do cargo test; done", "unsupported", "shell/unsupported-syntax"), ("./run.sh all", "unsupported", "command/other"), ("bazel test all", "unsupported", "build-driver/test"),
]
_REVIEW, _UNCLEAR = ("build-driver/test",), ("script/other", "command/other")
_SUGGESTED = {"build-driver/test": "test_summary"}
_CONFIDENCE = {"rg needle | head -5": "final_stage_only"}
_SYNTAX = {
    "cd src && cargo test --all": "and_list", "cargo test && git status": "and_list", "rg needle | head -5": "pipeline", "timeout 60 pytest -q": "wrapper", "set -o pipefail && rg needle | tail -3": "pipeline+and_list+mixed_syntax",
    "cargo build || cargo test": "or_list", "git log -1; git status": "sequence", "cat notes.txt | wc -l": "pipeline", "git status > out.txt": "redirection", "for f in a b; do cargo test; done": "sequence+loop+mixed_syntax", "./run.sh all": "path_invocation",
}


ORACLES["c4_features"] = _features_oracle()


@query
def c20_choices(spark, sf_dir):
    """What becomes of each distinct command: its rule or plan, confidence in its status, syntax, and the family of its unchanged results."""
    return selection.choices(_commands(spark, sf_dir)).select("command", "calls", "verdict", "rule", "reducer", "confidence", F.array_join("syntax", "+").alias("syntax"), "family", "kind", "suggested")


def _choice_values() -> str:
    q = lambda x: "null" if x is None else f"'{x}'"
    rows = []
    for command, verdict, name in _CHOICES:
        reduced = verdict == "reduce"
        kind = "existing_rule" if reduced else "review_candidate" if name in _REVIEW else "unclear" if name in _UNCLEAR else "required_pass_through"
        row = (command, verdict, name if reduced else None, (_CONFIDENCE.get(command) or "complete") if reduced else None, _SYNTAX.get(command, "simple_command"), f"existing/{name}" if reduced else name, kind, _SUGGESTED.get(name))
        rows.append(f"({', '.join(map(q, row))})")
    return ", ".join(rows)


def _rule_reducers() -> str:
    return ", ".join(f"('builtin/{i}', '{r}_summary')" for i, _, _, r in rule_data.REDUCE)


ORACLES["c20_choices"] = f"""
with {ctes(DUCK)},
c as (select {s.shell_command(DUCK, "tool_name", "input_format", "input_text")} as command, count(*) as calls from tool_calls group by 1 having command is not null),
k(command, verdict, rule, confidence, syntax, family, kind, suggested) as (values {_choice_values()}), r(rule, reducer) as (values {_rule_reducers()})
select command, calls, verdict, k.rule, coalesce(r.reducer, case when k.rule like 'compound/%' then k.rule[10:] end) as reducer, confidence, syntax, family, kind,
  case when verdict = 'reduce' then coalesce(r.reducer, k.rule[10:]) else suggested end as suggested from c left join k using (command) left join r on k.rule = r.rule"""


@query
def c22_taxonomy(spark, sf_dir):
    """Distinct commands by the taxonomy alone, as if no rule knew them: a join with its table."""
    words = selection.argv(_commands(spark, sf_dir)).where("argv is not null")
    return taxonomy.families(spark, taxonomy.named(words)).select("command", "family", "class", "reducer")


ORACLES["c22_taxonomy"] = f"""
with {ctes(DUCK)},
c as (select distinct {s.shell_command(DUCK, "tool_name", "input_format", "input_text")} as command from tool_calls),
w as (select command, string_split(regexp_replace(command, '^(FOO=1|timeout 60) ', ''), ' ') as argv from c where command is not null and not regexp_matches(command, '[|&;<>]')),
p as (select *, regexp_replace(argv[1], '^.*/', '') as program, coalesce(list_filter(argv[2:], lambda x: not starts_with(x, '-'))[1], '-') as first from w)
select command, case when program in ('ls', 'find', 'tree', 'df') then 'filesystem/' || program when program = 'ps' then 'system/ps' when program in ('make', 'ninja') then 'build/' || program
    when program in ('cat', 'sed') then 'inspection/exact-text' when program in ('rg', 'grep') then 'search/unsupported-form' when program = 'curl' then 'network/response' when program = 'jq' then 'structured-or-query-output'
    when program = 'echo' then 'shell/exact-small-output' when program = 'rm' then 'mutation/command' when program = 'python' then 'script/other' when program in ('cargo', 'go', 'pytest') then 'developer/' || program || '-other'
    when program = 'docker' then 'container/logs' when program = 'kubectl' then 'cluster/inspection' when program = 'gh' then 'gh/other-inspection' when program = 'git' then 'git/other' when program = 'npm' then 'package/npm-build-task'
    when program = 'pnpm' then 'package/pnpm-lint-task' when program = 'bazel' then 'build-driver/test' else 'command/other' end as family,
  case when program in ('ls', 'find', 'tree', 'df', 'ps', 'make', 'ninja', 'docker', 'kubectl', 'gh', 'npm', 'pnpm', 'bazel') then 'review_candidate'
    when program in ('cat', 'sed', 'rg', 'grep', 'curl', 'jq', 'echo', 'rm') then 'required_pass_through' else 'unclear' end as class,
  case when program in ('ls', 'find', 'tree', 'df', 'ps', 'kubectl', 'gh') then 'list_summary' when program in ('make', 'ninja', 'npm') then 'build_summary' when program = 'docker' then 'log_summary'
    when program = 'pnpm' then 'line_filter' when program = 'bazel' then 'test_summary' end as reducer
from p"""


@query
def r25_output_cap(spark, sf_dir):
    """Lengths of texts under the default cap: both ends at character borders with the marker between, by native functions."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").alias("bytes"), F.expr(reduce.capped_length("text", 5120, "[output capped]")).alias("capped"))


ORACLES["r25_output_cap"] = """
with h as (select doc_id, strlen(text) as n, hex(encode(text)) as x from documents),
a as (select *, list_max(list_filter([2552, 2551, 2550, 2549], lambda b: x[2 * b + 1:2 * b + 2] not between '80' and 'BF')) as head from h),
b as (select *, n - (5120 - 15 - head) as rest from a)
select doc_id, n as bytes, cast(case when n <= 5120 then n else head + 15 + n - list_min(list_filter([rest, rest + 1, rest + 2, rest + 3], lambda e: x[2 * e + 1:2 * e + 2] not between '80' and 'BF')) end as integer) as capped from b"""


def _archive(spark: SparkSession, sf_dir: str):
    rows = corpus(spark, sf_dir, "select call_key, output_text from first_results")
    snaps = rows.select("call_key", F.lit("stdout").alias("subject"), F.lit("before").alias("stage"), F.lit(None).cast("string").alias("completeness"), F.encode("output_text", "UTF-8").alias("body"))
    return archive.store(snaps)


@query
def k11_archive_roundtrip(spark, sf_dir):
    """Stored payloads after a verified round trip."""
    payloads, _ = _archive(spark, sf_dir)
    return archive.restore(payloads).select("sha256", F.octet_length("body").cast("long").alias("bytes"), F.col("fault").isNull().alias("sound"))


ORACLES["k11_archive_roundtrip"] = f"with {ctes(DUCK)} select sha256(output_text) as sha256, max(strlen(output_text)) as bytes, true as sound from first_results group by 1"


@query
def q6_search(spark, sf_dir):
    """Matches of two words with context, rendered, over the archive."""
    found = archive.sources(*_archive(spark, sf_dir))
    return archive.search(found, archive.Search(("error", "warning"), word=True, fold=True)).select("call_key", "matches", F.length("rendering").alias("chars"))


#: What the user types: two patterns, words in any case, no context, at most five matches.
TYPED = ("REF", "-e", "error", "-e", "warning", "-w", "-i", "-C", "0", "-m", "5")


@query
def q1_joint_search(spark, sf_dir):
    """A search as it is typed, over all sources of every call: matches of all of them, where the first is, and whether the rendering keeps its budget."""
    rows = corpus(spark, sf_dir, "select doc_id, call_key, output_text from first_results", deal=True)
    kinds = [("doc_id % 3 = 0", "stdout", None, "output_text"), ("doc_id % 3 = 0", "stderr", None, "'an error in ' || call_key || chr(10) || 'done'"), ("doc_id % 3 = 1", "result_text", "incomplete", "output_text"), ("doc_id % 3 = 2", "source_output", None, "output_text"), ("doc_id % 3 <> 2", "source_output", None, "'error and warning'")]
    snaps = None
    for where, subject, completeness, body in kinds:
        own = rows.where(where).selectExpr("call_key", f"'{subject}' as subject", "'before' as stage", f"cast({repr(completeness) if completeness else 'null'} as string) as completeness", f"encode({body}, 'UTF-8') as body")
        snaps = own if snaps is None else snaps.unionByName(own)
    found = archive.sources(*archive.store(snaps)).withColumn("archive_ref", F.concat(F.lit("yr_"), F.substring(F.sha2("call_key", 256), 1, 32)))
    _, s = search.parse(TYPED)
    out = search.joint(found, s, most_bytes=2048, most_lines=24)
    return out.select("call_key", "matches", "first", (F.octet_length("rendering") <= 2048).alias("fits"), F.col("rendering").startswith("[search: ref=yr_").alias("headed"))


ORACLES["q1_joint_search"] = f"""
with {ctes(DUCK)},
l as (select * from {DUCK.lines("first_results", "doc_id, call_key", "output_text")} x),
h as (select doc_id, call_key, line_no from l where regexp_matches(line, '(?i)\\b(?:error|warning)\\b')),
n as (select doc_id, call_key, count(*) as n, min(line_no) as line from h group by all),
e as (select doc_id, call_key from first_results where doc_id % 3 = 0)
select coalesce(n.call_key, e.call_key) as call_key, coalesce(n, 0) + case when e.doc_id is null then 0 else 1 end as matches,
  case when n is null then 'stderr:1' else case coalesce(n.doc_id, e.doc_id) % 3 when 0 then 'stdout:' when 1 then 'result_text:' else 'source_output:' end || line end as first, true as fits, true as headed
from n full join e on n.call_key = e.call_key"""


@query
def k13_lifecycle(spark, sf_dir):
    """Call states from the ordered operations of the event log: a user is a call, an event an operation."""
    op = "case event_type when 'signup' then 'begin_call' when 'view' then 'result_before' when 'click' then 'result_text' when 'purchase' then 'finish_call' else 'stage_result' end"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "cast(user_id as string) as call_key", "event_id as seq", f"{op} as operation", "case when event_type in ('view', 'click') then event_type end as subject", "sha2(props, 256) as sha256", "value > 50 as is_error"
    )
    return archive.lifecycle(e).withColumn("subjects", F.array_join("subjects", "+"))


ORACLES["k13_lifecycle"] = """
with o as (select cast(user_id as varchar) as call_key, event_id as seq, event_type, case when event_type in ('view', 'click') then event_type end as subject, props, value > 50 as is_error from events),
c as (select call_key, count(*) as conflicts from (select call_key, subject from o where subject is not null group by call_key, subject having count(distinct props) > 1) group by call_key),
w as (select *, min(seq) filter (where event_type = 'signup') over (partition by call_key) as begun, min(seq) filter (where event_type = 'purchase') over (partition by call_key) as ended from o),
m as (select call_key, count(*) as misplaced from w where begun is null or seq < begun or (ended is not null and seq > ended and event_type in ('view', 'click', 'error')) group by call_key)
select o.call_key, case when bool_or(event_type = 'purchase') then 'finished' else 'open' end as status, bool_or(event_type in ('view', 'click', 'purchase')) as executed,
  arg_max(is_error, seq) filter (where event_type = 'purchase') as is_error, coalesce(string_agg(distinct subject, '+' order by subject), '') as subjects, coalesce(max(c.conflicts), 0) as conflicts, coalesce(max(m.misplaced), 0) as misplaced
from o left join c on o.call_key = c.call_key left join m on o.call_key = m.call_key group by o.call_key"""


@query
def s11_committed_frames(spark, sf_dir):
    """Committed rows of framed streams made from the event log: a user is a stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rec = "case event_type when 'signup' then 'source_start' when 'purchase' then 'source_commit' when 'error' then 'source_rollback' when 'view' then 'tool_call' else 'tool_result' end"
    frames = e.selectExpr("cast(user_id as string) as stream", "event_id as seq", f"{rec} as record", "props as value")
    return ingest.committed(frames).groupBy("stream", "record").agg(F.count("*").alias("n"))


ORACLES["s11_committed_frames"] = """
with f as (select cast(user_id as varchar) as stream, event_id as seq, case event_type when 'signup' then 'source_start' when 'purchase' then 'source_commit' when 'error' then 'source_rollback'
  when 'view' then 'tool_call' else 'tool_result' end as record from events),
s as (select *, count(*) filter (where record = 'source_start') over (partition by stream order by seq) as source from f),
e as (select stream, source, min(seq) as seq, arg_min(record, seq) as record from s where record in ('source_commit', 'source_rollback') group by stream, source)
select s.stream, s.record, count(*) as n from s join e on s.stream = e.stream and s.source = e.source
where s.source > 0 and e.record = 'source_commit' and s.seq < e.seq and s.record <> 'source_start' group by s.stream, s.record"""


@query
def s11_daily_events(spark, sf_dir):
    """Events by day and type, the same plan that streams run under a watermark."""
    return ingest.windows(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


ORACLES["s11_daily_events"] = "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by 1, 2"


@query
def s12_archive_operations(spark, sf_dir):
    """Operations of length-prefixed streams made from the event log, checked, and the state of the calls that they give: a user is a stream, four events a call."""
    op = "case event_type when 'signup' then 'begin_call' when 'view' then 'result_before' when 'click' then 'result_text' when 'purchase' then 'finish_call' else 'close_call' end"
    message = f"""to_json(named_struct('requestId', event_id, 'schemaVersion', case when event_id % 17 = 0 then 2 else 1 end, 'operation', {op}, 'callId', cast(event_id % 4 as string), 'subject', case when event_type in ('view', 'click') then event_type end,
      'text', props, 'isError', value > 50, 'session', named_struct('agent', 'a', 'account', case when event_id % 19 <> 0 then 'b' end, 'sourceSessionId', cast(user_id as string))))"""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(user_id as string) as stream", "event_id as seq", f"{message} as message").withColumn("frame", frames.encode(F.col("message")))
    parts = e.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("seq", "frame"))).alias("f"))
    content = F.unhex(F.array_join(F.transform("f", lambda x: F.hex(x["frame"])), ""))
    torn = F.when(F.col("stream").cast("long") % 5 == 0, F.expr("substring(content, 1, octet_length(content) - 3)")).otherwise(F.col("content"))
    streams = parts.select("stream", content.alias("content")).withColumn("content", torn)
    ops = frames.operations(frames.split(streams))
    return ops.groupBy(F.coalesce("error", "operation").alias("outcome"), F.col("error").isNull().alias("accepted")).agg(F.count("*").alias("n"), F.countDistinct("stream").alias("streams"), F.count_distinct(F.when(F.col("error").isNull(), F.col("call_key"))).alias("calls"))


ORACLES["s12_archive_operations"] = """
with e as (select *, row_number() over (partition by user_id order by event_id desc) as back from events),
o as (select user_id, event_id, case when back = 1 and user_id % 5 = 0 then 'truncated frame' when event_id % 17 = 0 then 'unsupported schema version' when event_type not in ('signup', 'view', 'click', 'purchase') then 'unknown operation'
  when event_id % 19 = 0 then 'no call' end as error, case event_type when 'signup' then 'begin_call' when 'view' then 'result_before' when 'click' then 'result_text' when 'purchase' then 'finish_call' end as operation from e)
select coalesce(error, operation) as outcome, error is null as accepted, count(*) as n, count(distinct user_id) as streams, count(distinct case when error is null then user_id || '/' || event_id % 4 end) as calls from o group by 1, 2"""


