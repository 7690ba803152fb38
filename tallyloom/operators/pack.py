"""External rule packs: a manifest and JSON rule files, read strictly, checked, digested and compiled.

The pack's path is a parameter. Loading is a driver's task: a pack is a few hundred small files at most.
"""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SCHEMA_VERSION, MOST_RULES, MOST_PROGRAMS, MOST_TOKENS = 1, 10_000, 32, 64
ACTIONS, REDUCERS = ("reduce", "transform", "passthrough"), tuple(f"{x}_summary" for x in ("search", "diff", "test", "build", "log", "status", "list")) + ("line_filter",)
RULE_FIELDS, MATCH_FIELDS = {"id", "match", "action", "reducer", "transform", "success", "failure", "schema_version", "description"}, {"program", "argv_prefix", "argv_contains_all"}
LIMITS = {"max_line_bytes": (1, 1 << 20), "max_output_bytes": (704, 4 << 20), "min_savings_bytes": (0, 1 << 20), "min_savings_basis_points": (0, 10_000)}
#: Bytes of a reduction that don't depend on its rule: records, samples, fingerprints and keys of two collectors, and buffers.
STATE_BYTES = 336_512
_ID = re.compile(r"[a-z0-9][a-z0-9._/-]{0,127}")


class PackError(ValueError):
    """A pack that must not be used."""


def _strict(text: str):
    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise PackError("duplicate key")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=once)


def check(rule: dict) -> dict:
    """The rule, if it is well formed."""
    match = rule.get("match") or {}
    if set(rule) - RULE_FIELDS or set(match) - MATCH_FIELDS:
        raise PackError("unknown field")
    if not _ID.fullmatch(rule.get("id", "")) or rule.get("action") not in ACTIONS:
        raise PackError("id or action")
    programs = match.get("program") or []
    tokens = [*programs, *match.get("argv_prefix", []), *match.get("argv_contains_all", [])]
    if not 1 <= len(programs) <= MOST_PROGRAMS or len(set(programs)) != len(programs) or len(tokens) > MOST_TOKENS or not all(isinstance(t, str) and t for t in tokens):
        raise PackError("match")
    if rule["action"] == "reduce":
        if (rule.get("reducer") or {}).get("kind") not in REDUCERS:
            raise PackError("reducer")
        for policy in ("success", "failure"):
            for name, (low, high) in LIMITS.items():
                if not low <= rule.get(policy, {}).get(name, -1) <= high:
                    raise PackError(f"{policy}.{name}")
    return rule


def load(folder: str) -> tuple[str, list[dict], str]:
    """(pack id, rules, digest) of a folder with pack.json; nothing outside it is read."""
    root = Path(folder).resolve()
    manifest = _strict((root / "pack.json").read_text())
    names = manifest.get("rules", [])
    if manifest.get("schema_version") != SCHEMA_VERSION or len(names) > MOST_RULES or len(set(names)) != len(names):
        raise PackError("manifest")
    digest, rules = hashlib.sha256(b"rule-pack\0" + manifest["id"].encode() + b"\0"), []
    for name in names:
        path = root / name
        if path.is_symlink() or root not in path.resolve().parents:
            raise PackError("rule outside the pack")
        raw = path.read_bytes()
        digest.update(len(name).to_bytes(8, "big") + name.encode() + len(raw).to_bytes(8, "big") + raw)
        rules.append(check(_strict(raw.decode())))
    if len({r["id"] for r in rules}) != len(rules):
        raise PackError("duplicate rule")
    return manifest["id"], sorted(rules, key=lambda r: r["id"]), digest.hexdigest()


def compiled(spark: SparkSession, pack_id: str, rules: list[dict]) -> DataFrame:
    """A row for each program of a rule, with the digest of its canonical record."""
    rows = []
    for r in rules:
        record = json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        m = r["match"]
        rows += [(pack_id, r["id"], p, r["action"], (r.get("reducer") or {}).get("kind"), m.get("argv_prefix", []), m.get("argv_contains_all", []), record, hashlib.sha256(record.encode()).hexdigest()) for p in m["program"]]
    return spark.createDataFrame(rows, "pack_id string, rule_id string, program string, action string, reducer string, prefix array<string>, needed array<string>, record string, record_sha256 string")


def damaged(table: DataFrame) -> DataFrame:
    """Rows of a compiled table whose record no longer has its digest."""
    return table.where(F.sha2("record", 256) != F.col("record_sha256"))


def program_index(table: DataFrame) -> DataFrame:
    """program, rule_ids in order: which rules a program can meet."""
    return table.groupBy("program").agg(F.sort_array(F.collect_set("rule_id")).alias("rule_ids"))


def usable(packs: DataFrame) -> DataFrame:
    """Rules of several compiled packs without those whose id two packs claim: all owners lose them."""
    owners = packs.groupBy("rule_id").agg(F.countDistinct("pack_id").alias("n")).where("n > 1")
    return packs.join(owners, "rule_id", "left_anti")


def memory_bound(rules: DataFrame) -> Column:
    """Bytes that a reduction by a rule holds at most: rows with line_bytes, failure_line_bytes, output_bytes, failure_output_bytes, pattern_bytes.

    The raw text until it is longer than a summary, five sections of both summaries, a line and its samples, the patterns.
    """
    line, outputs = F.greatest(rules["line_bytes"], rules["failure_line_bytes"]), (rules["output_bytes"], rules["failure_output_bytes"])
    return F.greatest(*outputs) + 5 * (outputs[0] + outputs[1]) + 12 * line + rules["pattern_bytes"] + STATE_BYTES


def overlaps(table: DataFrame) -> DataFrame:
    """left, right: rules that aren't guards, share a program and have prefixes of which one begins the other: they can match one command."""
    t = table.where("action <> 'passthrough'").select("program", "rule_id", "prefix")
    pairs = t.toDF("program", "left", "p").join(t.toDF("program", "right", "q"), "program").where("left < right")
    begins = "slice(p, 1, least(size(p), size(q))) = slice(q, 1, least(size(p), size(q)))"
    return pairs.where(begins).select("left", "right").distinct()
