"""Search as it is typed, over several sources."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.operators import search as se
from tallyloom.operators.archive import Search


@pytest.mark.parametrize("typed,want", [
    (["R", "x"], ("R", Search(("x",)))), (["R", "-e", "a", "-e", "b", "-i", "-F", "-w", "-v"], ("R", Search(("a", "b"), True, True, True, True))),
    (["-C", "3", "R", "x", "-m", "100"], ("R", Search(("x",), before=3, after=3, limit=100))), (["R", "-A", "0", "-B", "50", "--", "-x"], ("R", Search(("-x",), before=50, after=0))),
    (["R", "x", "-C", "2", "-A", "2", "-A", "2"], ("R", Search(("x",)))),
])
def test_arguments(typed, want):
    assert se.parse(typed) == want


@pytest.mark.parametrize("typed", [
    [], ["R"], ["R", "x", "y"], ["R", "x", "-e", "y"], ["R", "x", "-A", "1", "-A", "2"], ["R", "x", "-C", "1", "-B", "2"], ["R", "x", "-A"], ["R", "x", "-A", "01"], ["R", "x", "-A", "51"], ["R", "x", "-A", "-1"],
    ["R", "x", "-m", "0"], ["R", "x", "-m", "101"], ["R", "x", "-q"], ["R", ""], ["R", *["-e", "a"] * 9], ["R", "a" * 1025], ["R", "x", "-m", "٣"],
])
def test_refused_arguments(typed):
    with pytest.raises(se.Usage):
        se.parse(typed)


def test_read_arguments():
    assert se.parse_read(["R", "1:2"]) == ("R", None, "lines", 1, 2) and se.parse_read(["R", "stdout", "--bytes", "0:9"]) == ("R", "stdout", "bytes", 0, 9)
    for bad in (["R"], ["R", "0:1"], ["R", "2:1"], ["R", "1"], ["R", "s", "x", "1:2"], ["R", "1:02"]):
        with pytest.raises(se.Usage):
            se.parse_read(bad)


A = b"one\ntwo error\nthree\nfour\nfive\nsix\nseven error\n"
B = b"warn\r\n\x1b[31merror\x1b[0m \x01here\r\n"


def shown(sources, s, **more):
    return se.rendered("yr_1", [se.scan(n, c, raw, s) for n, c, raw in sources], **more)


def test_renderings():
    """By hand."""
    one = [("stdout", None, A)]
    head = "[search: ref=yr_1]\n[source=stdout complete=true matches=2 showing=2 before={} after={} max_results=20]\n"
    assert shown(one, Search(("error",), before=0, after=0)) == head.format(0, 0) + "stdout:2:two error\n--\nstdout:7:seven error\nRead exact context: read yr_1 stdout 2:2\nRead exact context: read yr_1 stdout 7:7\n"
    assert shown(one, Search(("error",), before=1, after=1)) == head.format(1, 1) + "stdout-1-one\nstdout:2:two error\nstdout-3-three\n--\nstdout-6-six\nstdout:7:seven error\nRead exact context: read yr_1 stdout 1:3\nRead exact context: read yr_1 stdout 6:7\n"
    assert shown(one, Search(("error",))).count("--\n") == 0 and "Read exact context: read yr_1 stdout 1:7" in shown(one, Search(("error",)))
    both = shown([("stdout", None, A), ("stderr", "unknown", B)], Search(("error",), before=0, after=0, limit=1))
    assert both == (
        "[search: ref=yr_1]\n[source=stdout complete=true matches=2 showing=1 before=0 after=0 max_results=1]\nstdout:2:two error\n[search: 1 selected line(s) omitted]\nRead exact context: read yr_1 stdout 2:2\n"
        "--\n[source=stderr complete=unknown matches=1 showing=1 before=0 after=0 max_results=1]\nstderr:2:error \\x01here\nRead exact context: read yr_1 stderr 2:2\n"
    )
    none = shown([("stdout", None, b"x\n"), ("stderr", None, B)], Search(("error",), before=0, after=0))
    assert "[source=stdout complete=true matches=0 showing=0 before=0 after=0 max_results=20]\n--\n[source=stderr" in none
    assert shown(one, Search(("o",), invert=True, before=0, after=0)).count("stdout:") == 3 and shown(one, Search(("none",))) == ""
    assert "stdout:2:" in shown(one, Search(("ERROR",), fold=True, word=True)) and shown([("stdout", None, b"errors\n")], Search(("error",), word=True)) == ""


def test_shrinking():
    many = b"".join(b"hit %d %s\n" % (i, b"z" * 80) if i % 7 == 0 else b"line %d\n" % i for i in range(400))
    s = Search(("hit",), before=3, after=3, limit=30)
    wide = shown([("stdout", None, many)], s)
    small = shown([("stdout", None, many), ("stderr", None, B.replace(b"error", b"hit"))], s, most_bytes=1500, most_lines=60)
    assert len(wide.encode()) > 1500 >= len(small.encode()) and small.count("\n") <= 60 and "before=0 after=0" in small and "stderr:2:hit" in small
    tiny = shown([("stdout", None, many)], s, most_bytes=200, most_lines=3)
    assert tiny == "[search: ref=yr_1; matches=58; showing=0; omitted=58; first=stdout:1; read=read yr_1 stdout 1:1]\n"
    with pytest.raises(se.Usage):
        shown([("stdout", None, many)], s, most_bytes=20)
    scans = [se.Scan("a", "complete", 2, 3, 9, shown=[1]), se.Scan("b", "complete", 1, 1, 9, shown=[1, 2])]
    widths = [(x.before, x.after) for _ in se.shrunk(scans) for x in scans]
    assert widths[:4] == [(2, 2), (1, 1), (2, 1), (1, 1)] and all(x.shown == [] and x.before == x.after == 0 for x in scans)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"hit", b"", b"some text", b"hit " + "é".encode() * 3000, b"\x1b[1mhit", b"\x07"]), max_size=60), st.integers(0, 5), st.integers(1, 40), st.integers(300, 4000), st.integers(4, 60))
def test_budget(lines, context, limit, most, most_lines):
    raw = b"\n".join(lines)
    scans = [se.scan(n, None, x, Search(("hit",), before=context, after=context, limit=limit)) for n, x in (("stdout", raw), ("stderr", raw[: len(raw) // 2].decode(errors="ignore").encode()))]
    text = se.rendered("yr_" + "0" * 32, scans, most, most_lines)
    assert len(text.encode()) <= most and text.count("\n") <= most_lines and bool(text) == any(b"hit" in x for x in lines)


def test_sources_that_cannot_be_searched(spark):
    r = random.Random(3)
    rows = [("a", "yr_a", "stdout", "complete", bytearray(A)), ("a", "yr_a", "stderr", "complete", bytearray(B)), ("b", "yr_b", "result_text", "incomplete", bytearray(b"\xff error\n")), ("c", "yr_c", "stdout", "complete", bytearray(b"x" * (2 << 20))), ("d", "yr_d", "stdout", "complete", bytearray(b"quiet\n"))]
    r.shuffle(rows)
    found = spark.createDataFrame(rows, "call_key string, archive_ref string, subject string, completeness string, body binary")
    out = {x["call_key"]: x for x in se.joint(found, Search(("error",), before=0, after=0)).collect()}
    assert set(out) == {"a", "b", "c"} and (out["a"]["matches"], out["a"]["first"]) == (3, "stdout:2") and out["a"]["rendering"].index("stdout") < out["a"]["rendering"].index("stderr")
    assert out["b"]["error"].startswith("result_text is no text") and out["c"]["error"].startswith("stdout has a line of more")
    assert [bytes(x["body"]) for x in se.read(found, ["yr_a", "stdout", "2:3"]).collect()] == [b"two error\nthree\n"]
    assert [bytes(x["body"]) for x in se.read(found, ["yr_b", "result_text", "--bytes", "0:1"]).collect()] == [b"\xff"]
    assert se.read(found, ["yr_a", "1:1"]).count() == 0 and se.read(found, ["yr_d", "1:9"]).first()["error"] == "range beyond the source"
