"""Personal data: fixed patterns, and a character BiLSTM with a CRF for the forms they miss.

Base kinds, each leftmost and non-overlapping, failing matches dropped and not retried: ``email``,
``ip`` (four parts of at most 255), ``card`` (12 to 19 digits that pass Luhn), ``phone`` (``+`` and
9 to 15 digits).

The model reads characters in both directions (an LSTM each way), scores BIO tags of the four kinds
and decodes them under CRF transitions. It is trained in numpy, from a fixed seed, on generated
sentences with labelled spans, among them phone numbers without ``+`` and cards with dots, which the
patterns don't take. A text is cut into windows of ``WINDOW`` characters that overlap by half;
windows without a digit or ``@`` are skipped, as no kind can occur there. Each character takes its
scores from the window in whose middle it lies most, and one Viterbi pass over each unbroken stretch
decodes them, so that the windows' answers agree everywhere. Stretches of more than ``STRETCH`` windows
are decoded in parts of that many, each with ``MARGIN`` more windows on both sides; a span belongs to
the part in whose own characters it begins, and one that overlaps the span before it is dropped. A span the
model finds is added if it meets its kind's own rule (digits, Luhn, parts) and touches no base span.
At most ``HELD`` windows are scored at a time, however long a text is.

Edge cases: null and empty texts have no spans; texts are read whole; offsets are code points, ends
exclusive; rows with null ids and repeated rows each get theirs; of spans that tie in their start the
kinds come in the order above; an empty table gives no rows; input columns with the result's names (in
any case, as Spark compares them) are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
#: Windows of a part of a long stretch, those beside it that are decoded with it, and windows scored at a time.
STRETCH, MARGIN, HELD = 64, 4, 4096
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGNAL = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches, found from their at signs: linear however long a run of letters is."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and _LOCAL.match(text, s - 1):
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            found.append((s, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if _SIGNAL.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _digits(m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


# The model. Tags: 0 outside, 1 + 2k begins kind k, 2 + 2k goes on with it.
TAGS, VOCAB, EMBED, HIDDEN = 1 + 2 * len(KINDS), 131, 12, 16


def codes(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, then other letters, other spaces, the rest."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(a) and int(a.max()) < 128:
        return a.astype(np.int16)
    out = a.copy()
    for i in np.flatnonzero(a >= 128).tolist():
        c = chr(a[i])
        out[i] = 128 if c.isalpha() else 129 if c.isspace() else 130
    return out.astype(np.int16)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(table, wh, ids, keep=False):
    """Hidden states [n, t, h] of one direction; with keep also what backward needs."""
    n, t = ids.shape
    h, c, kept, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), [], np.empty((n, t, HIDDEN), np.float32)
    for k in range(t):
        z = table[ids[:, k]] + h @ wh
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, k] = h
        if keep:
            kept.append((*before, i, f, o, g, tc))
    return (out, kept) if keep else out


def _lstm_back(p, d, ids, kept, dh_out, grads):
    wh, n = p[f"wh{d}"], len(ids)
    dtable, dwh = np.zeros((VOCAB, 4 * HIDDEN), np.float32), np.zeros_like(wh)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for k in range(ids.shape[1] - 1, -1, -1):
        h0, c0, i, f, o, g, tc = kept[k]
        dh = dh + dh_out[:, k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        np.add.at(dtable, ids[:, k], dz)
        dwh += h0.T @ dz
        dh, dc = dz @ wh.T, dc * f
    grads[f"wh{d}"] = dwh
    grads[f"wx{d}"] = p["e"].T @ dtable
    grads[f"b{d}"] = dtable.sum(axis=0)
    grads["e"] += dtable @ p[f"wx{d}"].T


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def emissions(p, ids):
    """Tag scores [n, t, tags]."""
    f = _lstm(p["e"] @ p["wxf"] + p["bf"], p["whf"], ids)
    b = _lstm(p["e"] @ p["wxb"] + p["bb"], p["whb"], ids[:, ::-1])[:, ::-1]
    return np.concatenate([f, b], axis=2) @ p["wo"] + p["bo"]


def _step(p, ids, tags):
    """Loss and gradients of one batch: the CRF's log-likelihood, back through both directions."""
    n, t = ids.shape
    hf, kf = _lstm(p["e"] @ p["wxf"] + p["bf"], p["whf"], ids, True)
    hb, kb = _lstm(p["e"] @ p["wxb"] + p["bb"], p["whb"], ids[:, ::-1], True)
    h = np.concatenate([hf, hb[:, ::-1]], axis=2)
    em, a = h @ p["wo"] + p["bo"], p["a"]
    alpha, beta = np.empty((n, t, TAGS)), np.zeros((n, t, TAGS))
    alpha[:, 0] = em[:, 0]
    for k in range(1, t):
        alpha[:, k] = em[:, k] + _lse(alpha[:, k - 1, :, None] + a, 1)
    for k in range(t - 2, -1, -1):
        beta[:, k] = _lse(a + (em[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
    z = _lse(alpha[:, -1], 1)
    d_em = np.exp(alpha + beta - z[:, None, None])
    pairs = np.exp(alpha[:, :-1, :, None] + a + (em + beta)[:, 1:, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
    rows, cols = np.arange(n)[:, None], np.arange(t)[None]
    gold = em[rows, cols, tags].sum() + a[tags[:, :-1], tags[:, 1:]].sum()
    d_em[rows, cols, tags] -= 1
    np.add.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
    d_em = (d_em / n).astype(np.float32)
    g = {"a": pairs / n, "wo": np.tensordot(h, d_em, ((0, 1), (0, 1))), "bo": d_em.sum(axis=(0, 1)), "e": np.zeros_like(p["e"])}
    dh = d_em @ p["wo"].T
    _lstm_back(p, "f", ids, kf, dh[:, :, :HIDDEN], g)
    _lstm_back(p, "b", ids[:, ::-1], kb, dh[:, ::-1, HIDDEN:], g)
    return (z.sum() - gold) / n, g


def sentence(r: random.Random, length: int = WINDOW) -> tuple[str, list[tuple[int, int, str]]]:
    """A generated text of this length with labelled spans, and with figures that are none."""
    word = lambda a=2, b=9: "".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(a, b)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def item():
        kind = r.choice(KINDS)
        if kind == "email":
            return kind, f"{word()}{r.choice(['', '.' + word(), num(2), '_' + word()])}@{word()}.{r.choice(['com', 'org', 'net', 'de', 'co.uk', word(2, 3)])}"
        if kind == "ip":
            return kind, ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            s = r.choice(["", " ", "-", ".", " - "])
            return kind, s.join([r.choice("3456") + num(3), num(4), num(4), num(4)])
        cc, s = r.choice(["+1", "+44", "+49", "+33", "+34", "+" + num(2)]), r.choice([" ", "-", ".", ""])
        return kind, r.choice([f"{cc}{s}{num(3)}{s}{num(3)}{s}{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{cc} ({num(3)}) {num(3)}-{num(4)}", f"0{num(3)} {num(7)}"])

    def noise():
        return r.choice([num(r.randint(1, 5)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"${num(3)}.{num(2)}", f"v{num(1)}.{num(2)}", "@" + word(), f"{num(3)}%", num(r.randint(8, 12)), f"{num(2)}/{num(2)}/{num(4)}", hashlib.md5(num(5).encode()).hexdigest()[: r.randint(10, 24)], f"{num(3)},{num(3)}", "item_" + num(3)])

    text, spans = word(), []
    while len(text) < length:
        text += r.choice([" ", " ", " ", ", ", ". ", "\n", ": "])
        x = r.random()
        if x < 0.22:
            kind, s = item()
            spans.append((len(text), len(text) + len(s), kind))
            text += s
        else:
            text += noise() if x < 0.4 else word()
    return text[:length], [(s, e, k) for s, e, k in spans if e <= length]


@functools.lru_cache(2)
def trained(steps: int = 260, batch: int = 48, seed: int = 7) -> dict[str, np.ndarray]:
    """The model's weights, by Adam over generated sentences; the same for the same arguments."""
    rng, r = np.random.default_rng(seed), random.Random(seed)
    w = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    p = {"e": rng.normal(0, 0.5, (VOCAB, EMBED)).astype(np.float32), "wo": w(2 * HIDDEN, TAGS), "bo": np.zeros(TAGS, np.float32), "a": np.zeros((TAGS, TAGS))}
    for d in "fb":
        p |= {f"wx{d}": w(EMBED, 4 * HIDDEN), f"wh{d}": w(HIDDEN, 4 * HIDDEN), f"b{d}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}
    for i in range(TAGS):  # a tag that goes on follows its own kind
        for j in range(2, TAGS, 2):
            if i not in (j - 1, j):
                p["a"][i, j] = -30.0
    fixed = p["a"] == -30.0
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, steps + 1):
        ids, tags = np.zeros((batch, WINDOW), np.int16), np.zeros((batch, WINDOW), np.int64)
        for k in range(batch):
            text, spans = sentence(r)
            ids[k] = codes(text)
            for s, e, kind in spans:
                tags[k, s] = 1 + 2 * KINDS.index(kind)
                tags[k, s + 1 : e] = 2 + 2 * KINDS.index(kind)
        _, g = _step(p, ids, tags)
        norm = np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values()))
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for k, x in g.items():
            x = x * min(1.0, 5 / norm)
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            p[k] = p[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(p[k].dtype)
        p["a"][fixed] = -30.0
    return p


def _viterbi(em: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Best tags [n, t] of n stretches of one length with scores em [n, t, tags]."""
    best, back = em[:, 0].astype(np.float64), np.zeros(em.shape, np.int8)
    best[:, 2::2] -= 30
    rows = np.arange(len(em))
    for k in range(1, em.shape[1]):
        x = best[:, :, None] + a
        back[:, k] = x.argmax(axis=1)
        best = x.max(axis=1) + em[:, k]
    tags = np.empty(em.shape[:2], np.int8)
    tags[:, -1] = best.argmax(axis=1)
    for k in range(em.shape[1] - 1, 0, -1):
        tags[:, k - 1] = back[rows, k, tags[:, k]]
    return tags


def _meets_rule(kind: str, s: str) -> bool:
    d = _digits(s)
    if kind == "email":
        return "@" in s[1:-1] and "." in s.partition("@")[2]
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(x.isdigit() and x.isascii() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d) and len(s) <= 2 * len(d) and not any(c.isalpha() for c in s)
    return 9 <= len(d) <= 15 and any(c in "-.() +" for c in s) and not any(c.isalpha() for c in s)


def _parts(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(first window, windows, from, to): the parts to decode, and the characters whose spans are theirs."""
    half, k = WINDOW // 2, None
    runs: list[list[int]] = []
    for m in _SIGNAL.finditer(text):
        h = m.start() // half
        if h != k:
            k = h
            if runs and runs[-1][1] >= h - 2:
                runs[-1][1] = h
            else:
                runs.append([max(0, h - 1), h])
    for first, last in runs:
        for a in range(first, last + 1, STRETCH):
            b = min(a + STRETCH - 1, last)
            begin, end = max(first, a - MARGIN), min(last, b + MARGIN)
            yield begin, end - begin + 1, a * half if a > first else 0, (b + 1) * half if b < last else len(text)


def _decoded(p: dict, parts: list, windows: list[np.ndarray], out: list[list]) -> None:
    """Adds the spans of parts (text, length of the text, first window, windows, from, to) with these windows."""
    half, quarter, blocks = WINDOW // 2, WINDOW // 4, []
    for a in range(0, len(windows), 512):
        blocks.append(emissions(p, np.stack(windows[a : a + 512])).astype(np.float32))
    em, j, by_length = np.concatenate(blocks), 0, {}
    for part in parts:
        n = part[3]
        # the middle half of each window, and the outer quarters of the stretch's ends
        scores = np.concatenate([em[j, :quarter], em[j : j + n, quarter : quarter + half].reshape(-1, TAGS), em[j + n - 1, quarter + half :]])
        j += n
        length = min(len(scores), part[1] - part[2] * half)
        by_length.setdefault(length, []).append((part, scores[:length]))
    for length, some in by_length.items():
        for (i, _, k0, _, begin, end), tags in zip([x[0] for x in some], _viterbi(np.stack([x[1] for x in some]), p["a"]), strict=True):
            starts = np.flatnonzero(tags % 2 == 1)
            goes_on = np.append(tags[1:], 0)
            for s in starts.tolist():
                e = s + 1
                while e < length and goes_on[e - 1] == tags[s] + 1:
                    e += 1
                if begin <= k0 * half + s < end:
                    out[i].append((k0 * half + s, k0 * half + e, KINDS[tags[s] // 2]))


def model_spans(p: dict, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """What the model finds in each text, before any rule."""
    half, parts, windows, out = WINDOW // 2, [], [], [[] for _ in texts]
    for i, t in enumerate(texts):
        c = None
        for k0, n, begin, end in _parts(t):
            c = codes(t) if c is None else c
            for k in range(k0, k0 + n):
                x = c[k * half : k * half + WINDOW]
                windows.append(np.concatenate([x, np.full(WINDOW - len(x), 32, np.int16)]) if len(x) < WINDOW else x)
            parts.append((i, len(t), k0, n, begin, end))
            if len(windows) >= HELD:
                _decoded(p, parts, windows, out)
                parts, windows = [], []
    if parts:
        _decoded(p, parts, windows, out)
    for spans in out:
        spans.sort()
        spans[:] = [x for k, x in enumerate(spans) if not k or x[0] >= spans[k - 1][1]]
    return out


def scan(p: dict, texts: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans with the model's."""
    found = []
    for t, extra in zip(texts, model_spans(p, texts), strict=True):
        base = base_spans(t)
        starts = np.array([s for s, _, _ in base], np.int64)
        reach = np.maximum.accumulate(np.array([0] + [e for _, e, _ in base], np.int64))  # of the first so many spans
        free = lambda s, e: reach[np.searchsorted(starts, e)] <= s  # noqa: B023, E731
        added = [(s, e, k) for s, e, k in extra if _meets_rule(k, t[s:e]) and free(s, e) and not (s and t[s - 1].isalnum()) and not t[e : e + 1].isalnum()]
        found.append((base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]))) if added else base))
    return found


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCHEMA = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")])


def find(docs: DataFrame, text: str = "text", model: dict | None = None) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (of all base spans), base_sha256 and spans."""
    p, kept = model or trained(), [c for c in docs.columns if c.lower() not in SCHEMA.names]
    schema = T.StructType([docs.schema[c] for c in kept] + list(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # windows are scored many texts at a time
                b = whole.slice(at, 256)
                rows = scan(p, [t or "" for t in b.column(text).to_pylist()])
                columns = [pa.array([sum(x[2] == k for x in base) for base, _ in rows], pa.int64()) for k in KINDS]
                columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()))
                columns.append(pa.array([joined(spans) for _, spans in rows], pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + columns, names=kept + SCHEMA.names)

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
