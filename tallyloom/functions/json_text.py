"""Canonical JSON, keys, and the small JSON rules of agent logs, in plain Python."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from datetime import datetime


_RFC_3339 = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})")


def canonical(value) -> str:
    """Keys in byte order, no white space, text unescaped beyond what JSON needs."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def key(*parts: str | bytes | int) -> str:
    """SHA-256 over the parts, each after its length in 64 big-endian bits; whole numbers are 64 such bits."""
    h = hashlib.sha256()
    for p in parts:
        raw = struct.pack(">q", p) if isinstance(p, int) else p.encode() if isinstance(p, str) else p
        h.update(struct.pack(">Q", len(raw)) + raw)
    return h.hexdigest()


def millis(value) -> int | None:
    """Milliseconds since 1970 of an RFC 3339 text or a number taken as such; None for anything else."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return int(value)
    if not _RFC_3339.fullmatch(str(value)):
        return None
    try:
        at = datetime.fromisoformat(str(value).upper().replace("Z", "+00:00"))
    except ValueError:
        return None
    return round(at.timestamp() * 1000)


def rendered(content) -> str | None:
    """A text, or the text blocks of a list joined by line feeds; None without any."""
    if isinstance(content, str):
        return content
    texts = [b["text"] for b in content or [] if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)] if isinstance(content, list) else []
    return "\n".join(texts) if texts else None


def pruned(value, drop: frozenset[str]):
    """Without the named keys, nulls and what is left empty, at any depth."""
    if isinstance(value, dict):
        out = {k: pruned(v, drop) for k, v in value.items() if k not in drop}
        return {k: v for k, v in out.items() if v not in (None, {}, [])} or None
    if isinstance(value, list):
        return [x for x in (pruned(v, drop) for v in value) if x is not None] or None
    return value


def bounded(message: str, limit: int = 512) -> str:
    """At most limit bytes, cut at a character, an ellipsis for the rest."""
    raw = message.encode()
    return message if len(raw) <= limit else raw[:limit].decode(errors="ignore") + "…"
