"""From commands to rules: as a join for simple commands, as a fold over the parsed program for the rest.

``select_simple`` is relational: argv meets the broadcast rule table on the program, array predicates
check prefix and required words, an aggregate resolves the matches (a guard wins, one rule is taken,
several are ambiguous). ``plan`` folds compound commands in Python, once for each distinct command.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import rule_data, taxonomy
from tallyloom.operators.shell import WRAPPERS, Refused, Simple, features, parse, simple_words

ASSIGNMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*=")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")
# Fixed values.
QUIET_SET_FLAGS = frozenset(s + f for s in "-+" for f in "eufCmbnETPhkp")
CONFIDENCE = ("complete", "final_stage_only", "conditional")
STDIN_OPTIONS = {
    "tee": (("-a", "-i", "-p", "--append", "--ignore-interrupts", "--output-error"), ("--output-error=",)),
    "sort": (("-b", "-d", "-f", "-g", "-h", "-i", "-M", "-n", "-R", "-r", "-s", "-u", "-V", "--reverse", "--unique", "--numeric-sort", "--stable"), ("-k", "-t", "--key=", "--field-separator=")),
    "uniq": (("-d", "-i", "-u", "--repeated", "--ignore-case", "--unique"), ("-f", "-s", "-w")),
}


def normalised(argv: list[str]) -> list[str]:
    """The words after the program, past its reviewed global options; all of them if one lacks its value."""
    program, tail, i = argv[0], argv[1:], 0
    valued, alone = rule_data.OPTIONS_WITH_VALUE.get(program, ()), rule_data.OPTIONS_ALONE.get(program, ())
    while i < len(tail):
        if tail[i] in valued:
            if i + 1 == len(tail):
                return tail
            i += 2
        elif any(tail[i] == o or o.endswith("=") and tail[i].startswith(o) for o in alone) or (program == "cargo" and re.match(r"\+.", tail[i])):
            i += 1
        else:
            break
    return tail[i:]


def holds(word: str, required: str) -> bool:
    """A word is the required one, gives it a value, or bundles it among short flags."""
    if word == required or (required.startswith("--") and word.startswith(required + "=")):
        return True
    short = len(required) == 2 and required[0] == "-" != required[1]
    return short and len(word) > 2 and word[0] == "-" != word[1] and required[1] in word[1:]


@functools.cache
def _by_program() -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in rule_data.rules():
        for p in r["programs"]:
            out.setdefault(p, []).append(r)
    return out


def resolve(argv: list[str]) -> tuple[str, list[dict]]:
    """(verdict, rules) of one command: passthrough, reduce, transform, ambiguous or unsupported."""
    tail = normalised(argv)
    hits = [r for r in _by_program().get(argv[0], ()) if tail[: len(r["argv_prefix"])] == r["argv_prefix"] and all(any(holds(w, q) for w in tail) for q in r["contains"])]
    guards = sorted((r for r in hits if r["action"] == "passthrough"), key=lambda r: r["id"])
    if guards:
        return "passthrough", guards
    if len(hits) > 1:
        return "ambiguous", sorted(hits, key=lambda r: r["id"])
    return (hits[0]["action"], hits) if hits else ("unsupported", [])


def is_setup(words: list[str]) -> bool:
    """Commands that only prepare: no-ops, cd, quiet set flags, export, umask, assignments."""
    head, rest = words[0], words[1:]
    if all(ASSIGNMENT.match(w) for w in words) or (head in (":", "true", "false") and not rest):
        return True
    if head in ("cd", "umask"):
        return len(rest) == 1 and not rest[0].startswith("-")
    if head == "set":
        return len(rest) == 1 and rest[0] in QUIET_SET_FLAGS or rest in (["-o", "pipefail"], ["+o", "pipefail"])
    return head == "export" and bool(rest) and all(ASSIGNMENT.match(w) or NAME.match(w) for w in rest)


def may_emit(words: list[str]) -> bool:
    return all(ASSIGNMENT.match(w) for w in words) or words[0] in ("cd", "export", "umask")


def unwrapped(words: list[str]) -> list[str]:
    """The words without leading assignments and one wrapper; raises Refused at a second wrapper."""
    drop = lambda ws: ws[next((i for i, w in enumerate(ws) if not ASSIGNMENT.match(w)), len(ws)) :]
    words = drop(words)
    head, rest = (words[0], words[1:]) if words else ("", [])
    plain = bool(rest) and not rest[0].startswith("-")
    if head in ("env", "command", "exec"):
        words = rest[1:] if rest[:1] == ["--"] else rest
        words = drop(words) if head == "env" else words
    elif head == "time" and plain:
        words = rest
    elif head == "timeout" and plain and len(rest) >= 2:
        words = rest[1:]
    if words and words[0] in WRAPPERS:
        raise Refused("unsupported wrapper")
    return words


def line_preserving(words: list[str]) -> bool:
    """Whether a transform reads its input stream alone and passes on whole lines."""
    program, rest = words[0], words[1:]
    if program == "cat":
        return all(w == "-" for w in rest if w != "--") and rest.count("--") <= 1
    if program in ("head", "tail"):
        return re.fullmatch(r"(?:(?:-n ?[+-]?\d+|-\d+|--lines[= ][+-]?\d+|-q|--quiet|--silent|--|-) ?)*", " ".join(rest)) is not None
    exact, starts = STDIN_OPTIONS[program]
    for i, w in enumerate(rest):
        if w == "--" or (program == "tee" and (w == "-" or not w.startswith("-"))):
            return program == "tee" or all(x == "-" for x in rest[i + 1 :])
        if w in exact or w == "-" or any(w.startswith(s) and len(w) > len(s) for s in starts):
            continue
        if not (i and rest[i - 1] in starts):
            if w not in starts or i + 1 == len(rest):
                return False
    return True


def plan(command: str) -> dict:
    """The one reducer for a compound command's text; raises Refused where there is none.

    Gives reducer, limits merged by maximum, confidence in the exit status, the transforms whose
    diagnostics may mix in, and whether setup commands may have printed diagnostics.
    """
    program, chosen, confidence, transforms, setup_text, pipefail, had_output = parse(command), None, 0, [], False, False, False

    def take(rule):
        nonlocal chosen
        if chosen and chosen["reducer"] != rule["reducer"]:
            raise Refused("mixed reducers")
        chosen = {"reducer": rule["reducer"]} | {k: max(rule[k], chosen[k] if chosen else 0) for k in LIMITS}

    def stage(s: Simple, piped: bool):
        if is_setup(s.words):
            raise Refused("setup in a pipeline")
        words = unwrapped(s.words)
        if not words:
            raise Refused("no command")
        verdict, rules = resolve(words)
        if verdict == "reduce":
            take(rules[0])
            return True
        if verdict == "transform" and piped and line_preserving(words):
            transforms.append(words[0])
            return False
        raise Refused(verdict)

    for i, stages in enumerate(program.items):
        before = program.connectors[i - 1] if i else None
        emits = output = False
        if len(stages) == 1:
            words = stages[0].words
            if words[:1] == ["set"] and words[2:] == ["pipefail"]:
                pipefail = words[1] == "-o" if before in (None, "sequence") else None
            if is_setup(words) or not unwrapped(words):
                emits = is_setup(words) and may_emit(words)
                setup_text |= emits
            else:
                output = stage(stages[0], False)
        else:
            if pipefail is not True:
                confidence = max(confidence, 1)
            typed = False
            for s in stages:
                done = stage(s, typed)
                typed |= done
            output = True
        if before == "sequence" and had_output:
            confidence = max(confidence, 1)
        if before == "or" and (had_output or output or emits):
            confidence = 2
        had_output |= output or emits
    if chosen is None:
        raise Refused("no output command")
    return chosen | {"confidence": CONFIDENCE[confidence], "transforms": sorted(set(transforms)), "setup_text": setup_text}


#: What rules are named by: the pack's name, then the rule's id.
PACK = "builtin"


def choose(command: str) -> dict:
    """What becomes of a command's output: the simple command's rules first, else the plan for a compound one.

    verdict (reduce, passthrough, ambiguous or unsupported), rule (of a plan: ``compound/`` and its reducer), reducer,
    confidence, transforms, setup_text, limits; syntax: labels of the command's syntax; and family, kind and suggested
    reducer under which its results count where they are left as they are.
    """
    out = {"verdict": "unsupported", "rule": None, "reducer": None, "confidence": None, "transforms": [], "setup_text": False} | dict.fromkeys(LIMITS)
    syntax = features(command) or ["simple_command"]
    out["syntax"] = syntax + ["mixed_syntax"] * (len(syntax) > 1)
    try:
        words = simple_words(command)
        verdict, rules = resolve(words)
    except Refused:
        words, verdict, rules = None, "unsupported", []
    names = sorted({f"{PACK}/{r['id']}" for r in rules})
    if verdict in ("passthrough", "ambiguous"):
        group = "guarded" if verdict == "passthrough" else verdict
        return out | {"verdict": verdict, "family": f"{group}/{'+'.join(names)}", "kind": taxonomy.PASS, "suggested": None}
    if verdict == "reduce":
        out |= {"rule": names[0], "reducer": rules[0]["reducer"], "confidence": CONFIDENCE[0]} | {k: rules[0][k] for k in LIMITS}
    else:
        try:
            found = plan(command)
        except Refused:
            family, kind, suggested = taxonomy.assess(words)
            return out | {"family": family, "kind": kind, "suggested": suggested}
        out |= found | {"rule": f"compound/{found['reducer']}"}
    return out | {"verdict": "reduce", "family": f"existing/{out['rule']}", "kind": taxonomy.EXISTING, "suggested": out["reducer"]}


def rule_table(spark: SparkSession) -> DataFrame:
    """The pack, a row for each program of a rule: some 600 short rows, broadcast by their known size."""
    rows = [(p, r["id"], r["action"], r["reducer"], r["argv_prefix"], r["contains"]) for r in rule_data.rules() for p in r["programs"]]
    return spark.createDataFrame(rows, "program string, rule_id string, action string, reducer string, prefix array<string>, needed array<string>")


def argv(commands: DataFrame, command: str = "command") -> DataFrame:
    """Distinct commands with argv and tail (null where a command is not simple)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c in b["command"]:
                try:
                    words = simple_words(c)
                    rows.append((c, words, normalised(words)))
                except Refused:
                    rows.append((c, None, None))
            yield pd.DataFrame(rows, columns=["command", "argv", "tail"])

    distinct = commands.select(F.col(command).alias("command")).where("command is not null").distinct()
    return distinct.mapInPandas(run, "command string, argv array<string>, tail array<string>")


def select_simple(commands: DataFrame, rules: DataFrame) -> DataFrame:
    """command, verdict, rule_ids, reducer of every distinct command; argv as ``argv`` makes it."""
    c = commands.where("argv is not null")
    required = """forall(needed, q -> exists(tail, w -> w = q or (q like '--%' and startswith(w, concat(q, '=')))
      or (length(q) = 2 and startswith(q, '-') and q <> '--' and length(w) > 2 and startswith(w, '-') and not startswith(w, '--') and contains(substring(w, 2), substring(q, 2, 1)))))"""
    hits = c.join(F.broadcast(rules), F.expr("element_at(argv, 1)") == F.col("program")).where(F.expr("slice(tail, 1, size(prefix)) = prefix")).where(F.expr(required))
    found = hits.groupBy("command").agg(
        F.sort_array(F.collect_set(F.when(F.col("action") == "passthrough", F.col("rule_id")))).alias("guards"),
        F.sort_array(F.collect_set(F.when(F.col("action") != "passthrough", F.col("rule_id")))).alias("others"),
        F.max("action").alias("action"),
        F.max("reducer").alias("reducer"),
    )
    verdict = F.expr("case when size(guards) > 0 then 'passthrough' when size(others) > 1 then 'ambiguous' else action end")
    out = commands.join(found, "command", "left")
    return out.select(
        "command",
        F.when(F.col("argv").isNull(), "parse_error").otherwise(F.coalesce(verdict, F.lit("unsupported"))).alias("verdict"),
        F.expr("coalesce(case when size(guards) > 0 then guards else others end, cast(array() as array<string>))").alias("rule_ids"),
        F.expr("case when size(guards) = 0 and size(others) = 1 then reducer end").alias("reducer"),
    )


def _each(commands: DataFrame, make, schema: str) -> DataFrame:
    """A row (command, and what make gives) for each distinct command."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(c, *make(c)) for c in b["command"]], columns=["command", *names])

    distinct = commands.select("command").where("command is not null").distinct()
    return distinct.mapInPandas(run, f"command string, {schema}")


def syntax(commands: DataFrame) -> DataFrame:
    """command, labels of every distinct command."""
    return _each(commands, lambda c: (features(c),), "labels array<string>")


def choices(commands: DataFrame) -> DataFrame:
    """``choose`` of every distinct command, and how often it occurs."""
    names = ("verdict", "rule", "reducer", "confidence", "syntax", "family", "kind", "suggested")
    schema = ", ".join(f"{n} {'array<string>' if n == 'syntax' else 'string'}" for n in names)
    made = _each(commands, lambda c: tuple(choose(c)[n] for n in names), schema)
    return made.join(commands.groupBy("command").agg(F.count("*").alias("calls")), "command")


#: What plan() merges by maximum.
LIMITS = ("line_bytes", "failure_line_bytes", "least")


def plans(commands: DataFrame, command: str = "command") -> DataFrame:
    """command, reducer, confidence, transforms, setup_text, the merged limits, refused of every distinct command."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c in b["command"]:
                try:
                    p = plan(c)
                    rows.append((c, p["reducer"], p["confidence"], p["transforms"], p["setup_text"], p["line_bytes"], p["failure_line_bytes"], p["least"], None))
                except Refused as e:
                    rows.append((c, *[None] * 7, str(e)))
            frame = pd.DataFrame(rows, columns=["command", "reducer", "confidence", "transforms", "setup_text", *LIMITS, "refused"])
            yield frame.astype(dict.fromkeys(LIMITS, "Int64"))

    distinct = commands.select(F.col(command).alias("command")).where("command is not null").distinct()
    return distinct.mapInPandas(run, "command string, reducer string, confidence string, transforms array<string>, setup_text boolean, line_bytes long, failure_line_bytes long, least long, refused string")
