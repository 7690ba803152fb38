"""Personal data: base spans against the contract's patterns, the model on held-out sentences."""

import random
import re
import time
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import pii

PARTS = st.sampled_from(["a", "b.c", "@", "x-y", ".", "+", "1", "25", "300", "4532015112830366", " ", "-", "(", ")", "12.34.56.78", "+44 20 7946 0958", "\n", "é", "%", "٣"])


def plain(t):
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[2])))


@settings(max_examples=600, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base(text):
    assert pii.base_spans(text) == plain(text)


def test_long_numbers():
    """Parts of thousands of digits are numbers like others."""
    zeros = "0" * 5000
    assert pii.base_spans(f"build {zeros}.1.2.3 or {zeros}256.1.2.3") == [(6, 5012, "ip")]
    assert pii.base_spans(f"1.{zeros}25.{zeros}.255") == [(0, 10009, "ip")] and pii.base_spans("9" * 6000 + ".1.2.3") == []


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii.trained(steps=1, batch=2).items()}
    ids, tags = rng.integers(32, 127, (2, 6)), rng.integers(0, 2, (2, 6))
    _, g = pii._step(p, ids, tags)
    for k in ("whf", "wxb", "bo", "wo", "a"):
        at = tuple(0 for _ in p[k].shape)
        e = 1e-3
        p[k][at] += e
        up = pii._step(p, ids, tags)[0]
        p[k][at] -= 2 * e
        down = pii._step(p, ids, tags)[0]
        p[k][at] += e
        assert abs((up - down) / (2 * e) - g[k][at]) < 0.02 * max(1, abs(g[k][at]))


def test_model(spark):
    p, r = pii.trained(), random.Random(5)
    made = [pii.sentence(r, 300) for _ in range(60)]
    hits = wrong = missed = 0
    for (_, want), got in zip(made, pii.model_spans(p, [t for t, _ in made]), strict=True):
        hits, wrong, missed = hits + len(set(want) & set(got)), wrong + len(set(got) - set(want)), missed + len(set(want) - set(got))
    assert hits / (hits + wrong) > 0.8 and hits / (hits + missed) > 0.8
    long = "x" * 60000 + " call (212) 555-0187 now " + "1" * 30000
    rows = [(1, None), (1, ""), (2, long), (3, "me@host.org"), (3, "me@host.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as n_card")
    out = pii.find(docs, model=p).collect()
    assert len(out) == 5 and sum(x["n_email"] for x in out) == 2 and any("phone:" in x["spans"] for x in out if x["doc_id"] == 2)
    assert pii.find(docs.limit(0), model=p).count() == 0


def test_long_texts(monkeypatch):
    """Bounded memory and linear time however long an unbroken stretch of digits is; parts of a stretch agree with the whole."""
    p, r = pii.trained(), random.Random(3)
    tracemalloc.start()
    began = time.process_time()
    pii.scan(p, ["1234 5678-9012.3456 " * 5_000, "7" * 100_000, "a@" * 30_000])
    assert time.process_time() - began < 60 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    texts = [pii.sentence(r, 9000)[0] for _ in range(3)] + ["", "no figures", "1"]
    cut = pii.model_spans(p, texts)
    for size in (1 << 20, 3):
        monkeypatch.setattr(pii, "HELD", size)
        assert pii.model_spans(p, texts) == cut
    monkeypatch.setattr(pii, "STRETCH", 1 << 20)
    whole = pii.model_spans(p, texts)
    same = sum(len(set(a) & set(b)) for a, b in zip(cut, whole, strict=True))
    assert same >= 0.995 * sum(map(len, whole)) and same >= 0.995 * sum(map(len, cut))
    assert all(a[1] <= b[0] for spans in cut for a, b in zip(spans, spans[1:], strict=False))
