"""Scalar expressions as SQL text, for Spark and, in tests and oracles, for DuckDB.

A plan is written once over these; each engine gets its own spelling of what differs between them:
byte lengths, digests, regular expressions, typed JSON fields, splitting into lines.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    def octets(self, x: str) -> str:
        return f"octet_length({x})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def rx(self, x: str, pattern: str) -> str:
        return f"({x} rlike r'{pattern}')"

    def lines(self, rel: str, key: str, text: str) -> str:
        """Rows (key, line_no from 1, line); a final line feed ends the last line and begins none."""
        body = f"case when {text} like '%' || chr(10) then substring({text}, 1, length({text}) - 1) else {text} end"
        return f"(select {key}, pos + 1 as line_no, line from {rel} lateral view posexplode(split({body}, chr(10))) x as pos, line where {text} <> '')"

    def _variant(self, x: str, path: str, types: str, to: str) -> str:
        v = f"try_variant_get(try_parse_json({x}), '{path}', 'variant')"
        return f"case when schema_of_variant({v}) in ({types}) then try_variant_get(try_parse_json({x}), '{path}', '{to}') end"

    def json_int(self, x: str, path: str) -> str:
        return self._variant(x, path, "'BIGINT'", "bigint")

    def json_str(self, x: str, path: str) -> str:
        return self._variant(x, path, "'STRING'", "string")

    def json_bool(self, x: str, path: str) -> str:
        return self._variant(x, path, "'BOOLEAN'", "boolean")

    def json_has(self, x: str, path: str) -> str:
        return f"(try_variant_get(try_parse_json({x}), '{path}', 'variant') is not null)"

    def json_ok(self, x: str) -> str:
        return f"(try_parse_json({x}) is not null)"

    def long(self, x: str) -> str:
        return f"cast({x} as bigint)"

    def explode(self, rel: str, array: str, name: str, keep: str = "*") -> str:
        return f"(select {keep}, {name} from {rel} lateral view explode({array}) x as {name})"

    def unpivot(self, rel: str, columns: dict[str, str], name: str = "measure", value: str = "value", keep: str = "") -> str:
        """A row (name, value) for each of the columns of each row of rel; keep: columns before them."""
        pairs = ", ".join(f"'{n}', {c}" for n, c in columns.items())
        return f"(select {keep}{name}, {value} from {rel} lateral view stack({len(columns)}, {pairs}) x as {name}, {value})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def compact(self, x: str) -> str:
        return f"filter({x}, e -> e is not null)"

    def size(self, x: str) -> str:
        return f"size({x})"

    def append(self, x: str, y: str) -> str:
        return f"array_append({x}, {y})"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def count_if(self, x: str) -> str:
        return f"count_if({x})"

    def min_by(self, x: str, y: str) -> str:
        return f"min_by({x}, {y})"

    def be64(self, x: str) -> str:
        return f"lpad(hex({x}), 16, '0')"

    def hexed(self, x: str) -> str:
        return f"hex(encode({x}, 'UTF-8'))"

    def sha_hex(self, x: str) -> str:
        """SHA-256 of the bytes that x spells in hex digits."""
        return f"sha2(unhex({x}), 256)"

    def utf8(self, x: str) -> str:
        return f"encode({x}, 'UTF-8')"

    def micros(self, x: str) -> str:
        return f"unix_micros(cast({x} as timestamp))"

    def string_agg(self, x: str, order: str) -> str:
        return f"array_join(array_sort(collect_list({x})), '+')"

    def sub(self, x: str, a: str, n: str) -> str:
        return f"substring({x}, {a}, {n})"

    def longest_line(self, x: str) -> str:
        return f"array_max(transform(split({x}, chr(10)), e -> octet_length(e)))"


class Duck(Spark):
    name = "duckdb"

    def octets(self, x: str) -> str:
        return f"strlen({x})"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def rx(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def lines(self, rel: str, key: str, text: str) -> str:
        body = f"case when {text} like '%' || chr(10) then substring({text}, 1, length({text}) - 1) else {text} end"
        return (
            f"(select {key}, unnest(generate_series(1, len(string_split({body}, chr(10))))) as line_no, "
            f"unnest(string_split({body}, chr(10))) as line from {rel} where {text} <> '')"
        )

    def json_int(self, x: str, path: str) -> str:
        return f"case when json_valid({x}) and json_type({x}, '{path}') in ('UBIGINT', 'BIGINT') then cast(json_extract({x}, '{path}') as bigint) end"

    def json_str(self, x: str, path: str) -> str:
        return f"case when json_valid({x}) and json_type({x}, '{path}') = 'VARCHAR' then json_extract_string({x}, '{path}') end"

    def json_bool(self, x: str, path: str) -> str:
        return f"case when json_valid({x}) and json_type({x}, '{path}') = 'BOOLEAN' then cast(json_extract({x}, '{path}') as boolean) end"

    def json_has(self, x: str, path: str) -> str:
        return f"(case when json_valid({x}) then json_exists({x}, '{path}') else false end)"

    def json_ok(self, x: str) -> str:
        return f"coalesce(json_valid({x}), false)"

    def explode(self, rel: str, array: str, name: str, keep: str = "*") -> str:
        return f"(select {keep}, unnest({array}) as {name} from {rel})"

    def unpivot(self, rel: str, columns: dict[str, str], name: str = "measure", value: str = "value", keep: str = "") -> str:
        return f"(select {keep}unnest([{', '.join(repr(n) for n in columns)}]) as {name}, unnest([{', '.join(columns.values())}]) as {value} from {rel})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def compact(self, x: str) -> str:
        return f"list_filter({x}, lambda e: e is not null)"

    def size(self, x: str) -> str:
        return f"len({x})"

    def append(self, x: str, y: str) -> str:
        return f"list_append({x}, {y})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def min_by(self, x: str, y: str) -> str:
        return f"arg_min({x}, {y})"

    def be64(self, x: str) -> str:
        return f"lpad(printf('%X', {x}), 16, '0')"

    def hexed(self, x: str) -> str:
        return f"hex(encode({x}))"

    def sha_hex(self, x: str) -> str:
        return f"sha256(unhex({x}))"

    def utf8(self, x: str) -> str:
        return f"encode({x})"

    def micros(self, x: str) -> str:
        return f"epoch_us({x})"

    def string_agg(self, x: str, order: str) -> str:
        return f"string_agg({x}, '+' order by {order})"

    def longest_line(self, x: str) -> str:
        return f"list_max(list_transform(string_split({x}, chr(10)), lambda e: strlen(e)))"


SPARK, DUCK = Spark(), Duck()


def pattern(words: list[str], where: str = "c", fold: bool = False) -> str:
    """A regular expression that Java and RE2 read alike: any of the words contained (c), first (p), last (e) or alone (x)."""
    safe = "|".join("".join(f"\\x{ord(c):02x}" if c in "'{}" else "\\" + c if c in "\\^$.|?*+()[]-/" else c for c in w) for w in words)
    body = {"c": f"(?:{safe})", "p": f"^(?:{safe})", "e": f"(?:{safe})$", "x": f"^(?:{safe})$"}[where]
    return ("(?i)" if fold else "") + body
