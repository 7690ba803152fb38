"""Line classes by family, as data tables, and their expressions.

A row of a table is a class and the alternatives that give it; an alternative is a list of tests that
must all hold. A test is (where, fold, words): p first, c anywhere, e last; fold: ASCII case ignored.
The first row that holds wins. ``trim`` families look past leading spaces and tabs.
"""

from __future__ import annotations

from tallyloom.functions.dialect import Spark, pattern

# The vocabulary of the classes.
TOOL_OUTCOME = ["Process exited with code ", "Process running with session ID ", "Command exited with code ", "Command timed out"]
DIAGNOSTIC_WORDS = ["error", "failed", "failure", "warning", "panic", "fatal", "exception", "traceback", "segmentation fault"]
REFUSALS = ["cannot", "could not", "denied", "invalid", "no such", "unknown", "unrecognized"]
LEVELS = [" ERROR ", " WARNING ", " WARN ", " FATAL ", " PANIC "]
FIELDS = ["level=error", "level=warning", '"level":"error"', '"level":"warning"']
MONTHS = ["Jan ", "Feb ", "Mar ", "Apr ", "May ", "Jun ", "Jul ", "Aug ", "Sep ", "Oct ", "Nov ", "Dec "]
EMPTY = [[("x", False, [""])]]
FAMILIES: dict[str, tuple[bool, list]] = {
    "search": (False, [
        ("noise", EMPTY),
        ("diagnostic", [[("p", False, ["rg:", "grep:", "egrep:", "fgrep:", "git grep:", "error:"]), ("c", True, DIAGNOSTIC_WORDS + REFUSALS)]]),
        ("example", None),
    ]),
    "diff": (False, [
        ("structure", [[("p", False, ["diff --git ", "index ", "--- ", "+++ ", "@@ ", "Binary files ", "new file mode ", "deleted file mode ", "rename from ", "rename to "])]]),
        ("noise", [[("p", False, ["+++", "---"])]]),
        ("example", [[("p", False, ["+", "-"])]]),
        ("noise", None),
    ]),
    "test": (True, [
        ("outcome", [[("p", True, ["test result:", "failures:", "Test Files  ", "Tests  "])], [("c", True, [" passed in "])], [("c", True, [" failed, "]), ("c", True, [" passed"])]]),
        ("noise", [[("p", False, ["test "]), ("e", False, [" ... ok", " ok"])], [("p", False, ["Compiling ", "Checking ", "Fresh "])]]),
        ("diagnostic", [
            [("p", True, ["FAIL ", "FAILED ", "--- FAIL:", "not ok ", "AssertionError", "ZodError", "Caused by:", "Traceback", "error:", "error[", "npm error", "thread '", "E "])],
            [("p", False, ["❯"]), ("c", True, [" failed"])], [("c", True, ["testCodeFailure"])], [("c", True, ["stopping after "]), ("c", True, [" failure"])],
        ]),
        ("structure", [[("p", False, ["running ", "collected ", "test session starts"])]]),
        ("noise", EMPTY),
        ("example", None),
    ]),
    "build": (True, [
        ("outcome", [[("c", True, ["build successful", "build failed", "command failed with exit code", " passed in "])], [("p", True, ["Finished ", "Test Files  ", "Tests  ", "Build complete"])], [("p", False, ["✔ Build complete"])]]),
        ("example", [[("p", False, ["ℹ"])], [("c", False, ["├─ ", "└─ "])]]),
        ("diagnostic", [
            [("p", True, ["error:", "error[", "warning:", "warning[", "fatal:", "panic:", "exception:", "traceback", "failed ", "failure:", "npm error", "npm err!"])], [("p", False, ["✖", "×"])],
            [("c", True, ["##[error]", "##[warning]", "[error]", "[warning]", ": error ", ": warning ", " - error ts", " - warning ts", " command failed with exit code "])],
        ]),
        ("noise", EMPTY + [[("p", False, ["Compiling ", "Checking ", "Fresh ", "Downloaded ", "Downloading ", "Building ", "Generating ", "[ ", "[="])]]),
        ("structure", [[("p", False, ["> ", "[build]", "[package]"])]]),
        ("example", None),
    ]),
    "log": (False, [
        ("noise", EMPTY),
        ("diagnostic", [
            [("p", True, ["##[error]", "##[warning]", "[error]", "[warning]", "error: ", "warning: ", "fatal: ", "panic: "])],
            [("date", False, []), ("c", True, [*LEVELS, " FAILED ", *FIELDS])], [("p", False, MONTHS), ("c", True, [*LEVELS, " FAILED ", *FIELDS])],
        ]),
        ("example", None),
    ]),
    "status": (True, [
        ("outcome", [[("p", False, ["On branch ", "Your branch ", "HEAD detached", "## ", "Active:", "Loaded:"])], [("c", True, ["process completed with exit code", "command failed with exit code", "test files  ", "tests  "])]]),
        ("diagnostic", [[("c", True, ["##[error]", "##[warning]", "npm error", "failure reason:", *FIELDS])], [("c", False, LEVELS)]]),
        ("structure", [[("e", False, [":"])]]),
        ("noise", EMPTY),
        ("example", None),
    ]),
    "list": (False, [
        ("noise", EMPTY),
        ("diagnostic", [
            [("tp", True, ["error:", "fatal:", "warning:", "gh: error"])],
            [("tp", True, ["ls:", "find:", "fd:", "fdfind:", "tree:", "du:", "df:", "ps:", "lsof:", "free:"]), ("c", True, ["cannot", "could not", "denied", "error", "failed", "invalid", "no such", "unknown", "unrecognized"])],
        ]),
        ("outcome", [[("c", True, ["\tsuccess\t", "\tfailure\t", "\tcancelled\t", "\tin_progress\t", "\tqueued\t"])]]),
        ("example", None),
    ]),
}


def regexes(family: str) -> list[tuple[str, list[list[str]] | None]]:
    """The family's table as regular expressions over the line without its ending."""
    trim, rows = FAMILIES[family]
    lead = r"^[ \t]*"

    def one(where, fold, words):
        if where == "date":
            return r"^[0-9][0-9][0-9][0-9]-"
        if where == "x":
            return lead + "$" if trim else "^$"
        p = pattern(words, "p" if where == "tp" else where, fold)
        return p.replace("^", lead, 1) if where == "tp" or trim and where == "p" else p

    return [(c, None if alts is None else [[one(*t) for t in tests] for tests in alts]) for c, alts in rows]


def line_class(d: Spark, family: str, line: str) -> str:
    """The class of a line, tool outcomes first."""
    whens = [f"when {d.rx(line, pattern(TOOL_OUTCOME, 'p').replace('^', '^[ ' + chr(92) + 't]*', 1))} then 'outcome'"]
    for c, alts in regexes(family):
        if alts is None:
            return f"case {' '.join(whens)} else '{c}' end"
        cond = " or ".join("(" + " and ".join(d.rx(line, p) for p in tests) + ")" for tests in alts)
        whens.append(f"when {cond} then '{c}'")
    raise ValueError(family)
