"""Scalar rules of the log domain: shell commands, outcomes, bands, properties, budgets, keys."""

from __future__ import annotations

from tallyloom.functions.dialect import Spark, pattern

# Fixed values.
SHELL_TOOLS = ("bash", "exec_command", "run_terminal_cmd")
DIAGNOSTIC_TERMS = ("failure", "panic", "error", "warning", "test result")
TRANSPORT_MARKERS = ("Process running with session ID", "Command exited with code", "Process exited with code", "timed out")
TRUNCATION_KEYS = ("truncated", "isTruncated")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SETUP_DIAGNOSTICS = ("cd:", "umask:", "export:", "readonly variable", "not a valid identifier")
BUDGET, BUDGET_LEAST, BUDGET_POINTS = 704, 256, 1500


def shell_command(d: Spark, tool: str, form: str, text: str) -> str:
    """The command a shell tool was given: the text itself, or the JSON input's command, else cmd. A command that is no string gives null."""
    low = f"translate({tool}, '{UPPER}', '{LOWER}')"
    shell = f"({low} in {SHELL_TOOLS} or {low} like '%shell%')"
    asked = f"case when {d.json_has(text, '$.command')} then {d.json_str(text, '$.command')} else {d.json_str(text, '$.cmd')} end"
    return f"case when not {shell} then null when {form} = 'text' then {text} else {asked} end"


def succeeded(d: Spark, is_error: str, json: str) -> str:
    """True, false or null: an integer exit code decides, then a failed status, then the flag."""
    code = f"coalesce({', '.join(d.json_int(json, p) for p in ('$.exit_code', '$.exitCode', '$.details.exit_code', '$.details.exitCode'))})"
    return f"case when {code} is not null then {code} = 0 when {d.json_str(json, '$.status')} = 'failed' then false else not {is_error} end"


def size_band(d: Spark, text: str) -> str:
    n = d.octets(text)
    return f"case when {n} < 1000 then '000000-000999' when {n} < 10000 then '001000-009999' when {n} < 100000 then '010000-099999' else '100000+' end"


def line_count(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')) + case when {text} <> '' and {text} not like '%' || chr(10) then 1 else 0 end)"


def percent(n: str, d: str) -> str:
    return f"case when {d} = 0 then 0e0 else {n} * 100e0 / {d} end"


def has_diagnostic(d: Spark, text: str) -> str:
    return d.rx(text, pattern(list(DIAGNOSTIC_TERMS), "c", True))


def host_truncated(d: Spark, json: str) -> str:
    """Whether JSON somewhere says that it was truncated: a member of that name, true."""
    said = f'"({"|".join(TRUNCATION_KEYS)})"[ \\t\\r\\n]*:[ \\t\\r\\n]*true'
    return f"coalesce({d.json_ok(json)} and {d.rx(json, said)}, false)"


def exit_code(d: Spark, json: str) -> str:
    """The first 32-bit exit code at most two details deep, outer ones first; null without one."""
    fit = lambda v: f"case when {v} between -2147483648 and 2147483647 then {v} end"
    paths = [f"$.{'details.' * depth}{name}" for depth in range(3) for name in ("exit_code", "exitCode")]
    return f"coalesce({', '.join(fit(d.json_int(json, p)) for p in paths)})"


def completeness(d: Spark, json: str, full: str) -> str:
    """complete where the host has the whole output or says that it cut nothing; incomplete where it says that it did; else unknown."""
    inner = ["", "truncation.", "truncation.truncation.", "truncation.details.", "details.", "details.truncation.", "details.details."]
    said = f"coalesce({', '.join(d.json_bool(json, f'$.{p}truncated') for p in inner)})"
    return f"case when {full} then 'complete' when {said} then 'incomplete' when not {said} then 'complete' else 'unknown' end"


def recovery_marker(text: str, ref: str) -> str:
    """Whether a text names an archived original and how to search it."""
    return f"({text} like '%' || {ref} || '%' and {text} like '%search ' || {ref} || '%')"


def recovery_command(d: Spark, command: str, program: str) -> str:
    """Whether a command of plain words searches or reads the archive, and doesn't ask for help."""
    return f"({d.rx(command, f'^{program} (search|read)( |$)')} and not {d.rx(command, '^[^ ]+ [^ ]+( .*)? (--help|-h)( |$)')})"


def result_properties(d: Spark, text: str, json: str) -> str:
    """Labels of a result's text; line lengths by bytes, not characters."""
    longest = d.longest_line(text)
    return d.compact(
        d.array(
            f"case when {d.octets(text)} > length({text}) then 'non_ascii' end",
            f"case when {longest} > 16384 then 'long_line_16k' end",
            f"case when {longest} > 1048576 then 'oversized_line_1m' end",
            f"case when {host_truncated(d, json)} then 'host_truncated' end",
            f"case when {d.rx(text, pattern(list(TRANSPORT_MARKERS)))} then 'transport_outcome' end",
        )
    )


def budget_removal(d: Spark, chars: str, budget: int = BUDGET, least: int = BUDGET_LEAST, points: int = BUDGET_POINTS) -> str:
    """Characters a budget would remove: none if that is too few, or too small a share."""
    gone = f"greatest({chars} - {budget}, 0)"
    share = d.div(f"{gone} * 10000", f"greatest({chars}, 1)")
    return f"case when {gone} < {least} or {share} < {points} then 0 else {gone} end"


def key(d: Spark, *parts: str) -> str:
    """SHA-256 over the parts, each after its length as 64 big-endian bits; parts are SQL strings."""
    spelled = " || ".join(f"{d.be64(d.octets(p))} || {d.hexed(p)}" for p in parts)
    return d.sha_hex(spelled)


def archive_ref_ok(d: Spark, ref: str) -> str:
    return d.rx(ref, "^yr_[0-9a-f]{32}$")


def assignment(d: Spark, word: str) -> str:
    return d.rx(word, "^[A-Za-z_][A-Za-z0-9_]*=")
