"""The shell reader, the rule pack and the planner."""

import pytest

from tallyloom.operators import rule_data, selection, shell


def test_every_rule_selects_itself():
    rules = rule_data.rules()
    assert len(rules) == 339 and len({r["id"] for r in rules}) == 339
    for r in rules:
        assert selection.resolve([r["programs"][-1], *r["argv_prefix"], *r["contains"]])[0] == r["action"], r["id"]


@pytest.mark.parametrize(
    "command,words",
    [("rg 'a b' \"c\\\"d\" e\\ f", ["rg", "a b", 'c"d', "e f"]), ("a=1 x a*b ~", ["a=1", "x", "a*b", "~"]), ("  ls  ", ["ls"]), ("x ''", ["x", ""]), ("n x#y", None)],
)
def test_words(command, words):
    if words is None:
        with pytest.raises(shell.Refused):
            shell.simple_words(command)
    else:
        assert shell.simple_words(command) == words


@pytest.mark.parametrize("command", ["", "a &", "a | ", "a && ", "$x", "a `b`", "a > f", "a <<E", "(a)", "{ a; }", "a {b,c}", "*", "-n*", "'a", "# c", "if a; then b; fi", "a |& b", "a 2>&1 > f", "x " * 200_000])
def test_refused(command):
    with pytest.raises(shell.Refused):
        shell.parse(command)


def test_features():
    assert shell.features("ls -la") == []
    assert shell.features("a | b && c || d; e") == ["pipeline", "and_list", "or_list", "sequence"]
    assert shell.features("for x in a; do echo $x; done > f") == ["sequence", "parameter_expansion", "redirection", "loop"]
    assert shell.features("echo '$x | y' \"a && b\"") == []


@pytest.mark.parametrize(
    "command,reducer,confidence",
    [
        ("cd x && cargo test 2>&1 | tail -5", "test_summary", "final_stage_only"),
        ("set -o pipefail; cargo test | head -n 3", "test_summary", "complete"),
        ("rg a; rg b", "search_summary", "final_stage_only"),
        ("rg a || rg b", "search_summary", "conditional"),
        ("export A=1 B && C=2 timeout 5 pytest -q", "test_summary", "complete"),
        ("rg a | cargo test", None, None),
        ("cat f | rg a", None, None),
        ("rg --json a", None, None),
        ("cd x", None, None),
        ("rg a | sort -o f", None, None),
        ("git -C d --no-pager grep x | sort -u | uniq", "search_summary", "final_stage_only"),
    ],
)
def test_plans(command, reducer, confidence):
    if reducer is None:
        with pytest.raises(shell.Refused):
            selection.plan(command)
    else:
        p = selection.plan(command)
        assert (p["reducer"], p["confidence"]) == (reducer, confidence)


def test_join_is_the_fold(spark):
    commands = [" ".join([r["programs"][0], *r["argv_prefix"], *r["contains"]]) for r in rule_data.rules()] + ["rg -sbc x", "git --no-pager status", "git -C", "nothing here", "a | b", "cargo +nightly test", "gh pr list --json=id"]
    df = spark.createDataFrame([(c,) for c in commands], "command string")
    got = {r["command"]: r for r in selection.select_simple(selection.argv(df), selection.rule_table(spark)).collect()}
    for c in commands:
        try:
            verdict, rules = selection.resolve(shell.simple_words(c))
            assert (got[c]["verdict"], got[c]["rule_ids"]) == (verdict, [r["id"] for r in rules]), c
        except shell.Refused:
            assert got[c]["verdict"] == "parse_error"
