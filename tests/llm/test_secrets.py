"""Secret scanning against the patterns as the contract has them."""

import re
import time
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import secrets

PARTS = st.sampled_from(["password", "PassWd", "secret", "token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH1234567890XY", "deadbeef" * 3, "0123", "\n", "é", "x", ".", "/", "K"])


def plain(text):
    found = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((*m.span(), "assign"))
    found += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base(text):
    assert secrets.base_spans(text) == plain(text)
    base, spans = secrets.scan(text)
    assert set(base) <= set(spans)


def test_named():
    text = 'part = "s8Kq2ZxP"\nclient_credential = part + "vT71mWc0"\ncolor: blue\nprivateKey: Zk29sLq81XvbPq7\n'
    spans = [text[s:e] for s, e in secrets.named(text)]
    assert spans == ['part + "vT71mWc0', "Zk29sLq81XvbPq7"]
    assert secrets.named("The key: is under the mat. Access = granted.") == []


def test_cases(spark):
    rows = [(1, None), (1, ""), (2, "token: abcdef" + " x" * 50000), (3, "a" * 100000), (4, "=" * 5000), (4, "=" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as n_hex")
    out = secrets.find(docs, redacted=True).collect()
    assert len(out) == 6 and sum(r["n_assign"] for r in out) == 1 and sum(r["n_hex"] for r in out) == 1
    assert {r["redacted"][:8] for r in out if r["doc_id"] == 2} == {"[assign]"}
    assert secrets.find(docs.limit(0)).count() == 0


def test_long_texts():
    """Time grows with the length: quotes that nothing closes, escapes, openers, constants of constants."""
    key = "Zk29sLq81XvbPq7"
    many = ['a="' + '\\"' * 500_000, "a='" + "\\'" * 500_000, 'x="' + "' \"" * 200_000, "token = [" * 100_000, "a:" * 300_000, "= " * 500_000, '"a" + ' * 100_000, "{'a': " * 100_000]
    for text in many:
        began = time.process_time()
        secrets.scan(text)
        assert time.process_time() - began < 15, text[:20]
    # what comes after an open quote is still read
    for text in (f"it's so private_key = {key}", f'say "so private_key = {key}', f"it's private_key = \"{key}\"", f'a = "b \' c\nprivate_key = "{key}"'):
        assert [text[s:e] for s, e in secrets.named(text)] == [key], text
    doubled = "\n".join(["a = 'abcdefgh1234'"] + ["a = a + a"] * 60 + [f"private_key = '{key}'"])
    assert doubled[slice(*secrets.named(doubled)[-1])] == key


def test_constants_cost_once():
    """A long constant named over and over: its characters are neither joined nor scored again."""
    key = "Zk29sLq81XvbPq7" * 273
    forms = [f'K="{key}"\nA=' + "+".join("K" * 500_000), f'K="{key}"\n' + "\n".join(f"secret_{i}=K" for i in range(120_000)), f'K="{key[:4000]}"\n' + "\n".join(f"secret_{i}=K+'x'" for i in range(90_000))]
    for text in forms:
        peak, began = 0, time.process_time()
        tracemalloc.start()
        secrets.scan(text[:200_000])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60_000_000, (text[:9], peak)
        began = time.process_time()
        found = secrets.named(text)
        assert time.process_time() - began < 10, (text[-20:], time.process_time() - began)
        assert len(found) == text.count("\n") * ("secret_" in text)
    joined = "a = 'Zk29s'\nb = 'Lq81Xvb'\nprivate_key = a + b + a"
    assert secrets.named(joined) and secrets.literal_score("Zk29sLq81XvbZk29s") >= 0.5


def test_forms():
    a, b, c = "s8Kq2ZxPvT71mWc0", "Zk29sLq81XvbPq7", "Qw83nTy60RbLx5"
    one = [
        f'db_password: str = "{a}"', f"const authToken: string = '{a}';", f'apiToken?: string | null = "{a}"', f'private_key: Optional[list[str]] = "{a}"',
        f'db_password: str =\n    "{a}"', f'settings["private_key"] = "{a}"', f"$conf['db']['passphrase'] = '{a}';", f'["private_key"] = "{a}",',
        f'private_key =\n  "{a}"', f'private_key = (\n  "{a}"\n)', f'private_key = \\\r\n  "{a}"\r\n', f"private_key:\n\n  {a}\nother: x", f"private_key: >-\n  {a}", f'"private_key":\n  "{a}",',
        f'auth:\n  "private_key": "{a}"', f"auth:\n  private_key: {a}", f'note: set private_key = "{a}"', f"private_key: {a}\r\nx: y", f'+private_key =\n+  "{a}"', f'private_key = ("{a}")',
    ]
    for text in one:
        assert [text[s:e] for s, e in secrets.named(text)] == [a], text
        assert a not in secrets.redact(text, secrets.scan(text)[1]), text
    many = [f'private_key = (\n  "{a}"\n  "{b}"\n)', f'private_key = "{a}" +\n  "{b}"', f"private_key = '{a}'\n    + '{b}';", f'private_key = "{a}" \\\n  "{b}"']
    for text in many:
        assert [text[s:e].split(a)[1].split(b)[1] for s, e in secrets.named(text)] == [""], text
    two = [f"private_key: {a}+\npassword: {c}", f'{{"private_key": "{a}" "password": "{c}"}}', f'+private_key = "{a}"\n+password = "{c}"', f"private_key: {a}\n\\\npassword: {c}"]
    for text in two:
        assert [text[s:e] for s, e in secrets.named(text)] == [a, c], text
    for text in ("The key:\nis under Mat12xyzQ the mat", "token: SecretStringType = None", "auth:\n  - name: x", "token =", "token: (", 'x["token"] =', "token?:", 'token: "', "[[:=\n" * 2000, "a: [" * 5000, "=\n\n" * 5000):
        assert len(secrets.named(text)) == (1 if "SecretString" in text else 0), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "[", "]", "(", "?", "+", "\\", "\n", "\r", " ", ":", "=", "=>", '"', "'", "Zk29sLq81XvbPq7", "|", ">", "-", "x", ","]), max_size=16).map("".join))
def test_any_forms(text):
    assert all(0 <= s <= e <= len(text) for s, e in secrets.named(text))
