"""The numbered queries: thin contracts over the operators of this subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, embedding_dedup, jaccard_join, packing, pii, prefix_trie, secrets, sharding, structure_repair, substring_dedup, token_counts, toxicity, url_filter
from tallyloom.llm._shared import ready


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _count(spans: str) -> Column:
    """How many spans a list of them names, the method's with the base ones."""
    return F.when(F.col(spans) == "", 0).otherwise(F.size(F.split(spans, ","))).cast("long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "n_words")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    packed = packing.pack(spark, docs, tokenizer_path(), end_id=2, size=4096, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.similar(spark, docs).select("doc_id", "n_shingles", "component_id")


#: (verdict, host/path) of the contract.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = f"""
with rules(rule, verdict) as (values {", ".join(f"('{r}', '{v}')" for v, r in URL_RULES)}),
r as (select rule, verdict, split_part(rule, '/', 1) as rh, substr(rule, strpos(rule, '/')) as rp from rules),
p as (select page_id, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end, '') as rest from pages),
q as (select page_id, regexp_extract(rest, '^[^/?#]*') as h, rest from p),
s as (select page_id, translate(h, '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from q),
u as (select distinct host, path from s),
m as (select host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from u join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by host, path)
select s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, '{url_filter.DEFAULT_VERDICT}') as verdict
from s left join m on s.host = m.host and s.path = m.path
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", _count("spans").alias("n_spans"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminated(spark, docs, _table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove(spark, docs, k=20, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", _count("spans").alias("n_spans"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark, _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return structure_repair.repair(spark, structure_repair.damaged(turns))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    size, crc = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16, F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    dealt = sharding.shard(spark, docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.of_lent(spark, _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP3_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from d),
n as (select d.doc_id, count(g) as n from d left join s on d.doc_id = s.doc_id group by d.doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * o >= 80 * (x.n + y.n - o)),
e as (select a, b from l union all select b, a from l),
r(doc_id, node) as (select doc_id, doc_id from n union select r.doc_id, e.b from r join e on r.node = e.a)
select n.doc_id, n.n as n_shingles, min(r.node) as component_id from n join r on n.doc_id = r.doc_id group by n.doc_id, n.n
"""

OP8_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, unnest(generate_series(1, len(w) - 19)) as i, unnest(list_transform(generate_series(1, len(w) - 19), lambda i: array_to_string(w[i:i + 19], ' '))) as g from d where len(w) >= 20),
f as (select doc_id, i, min(doc_id * 1000000 + i) over (partition by g) < doc_id * 1000000 + i as later from x),
c as (select distinct doc_id, unnest(range(i, i + 20)) as k from f where later),
v as (select doc_id, unnest(generate_series(1, len(w))) as k, unnest(w) as word from d where len(w) > 0),
t as (select v.doc_id, count(c.k) as n_removed, coalesce(string_agg(v.word, ' ' order by v.k) filter (where c.k is null), '') as kept from v left join c on v.doc_id = c.doc_id and v.k = c.k group by v.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join t on d.doc_id = t.doc_id
"""

#: CRC-32 of the conversation's number in decimals, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))))"""

OP13_SQL = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, list(length(role) || ':' || role || text order by turn nulls first, role, text) as s,
  list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) order by turn nulls first, role, text) as w from t group by conv_id),
b as (select *, conv_id - conv_id % 20 as base, {_CRC} % 4 as h from o),
r as (select c.conv_id, case when c.base = c.conv_id then c.s else list_concat(coalesce(o.s[1:h], []), c.s[h + 1:]) end as s,
  case when c.base = c.conv_id then c.w else list_concat(coalesce(o.w[1:h], []), c.w[h + 1:]) end as w from b c left join o on o.conv_id = c.base),
n as (select conv_id, unnest(range(len(s) + 1)) as d, s, w from r),
g as (select d, s[1:d] as p, min(conv_id) as conv_id, count(*) as n_convs, coalesce(any_value(w[d]), 0) as words,
  coalesce(string_agg(conv_id, ',' order by conv_id) filter (len(s) = d), '') as ends from n group by d, s[1:d]),
k as (select d - 1 as d, p[1:d - 1] as p, count(*) as n_children from g where d > 0 group by all),
f as (select g.*, coalesce(n_children, 0) as n_children from g left join k on g.d = k.d and g.p = k.p),
u as (select a.d, a.p, sum((x.n_convs - 1) * x.words) as saved, count(*) filter (x.n_children = 0) as leaves from f a join f x on x.d >= a.d and x.p[1:a.d] = a.p group by a.d, a.p)
select f.conv_id, cast(f.d as bigint) as depth, q.conv_id as parent_conv_id, f.n_convs, f.n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, sha256(f.ends) as ends_sha256
from f join u on f.d = u.d and f.p = u.p left join g q on q.d = f.d - 1 and q.p = f.p[1:f.d - 1]
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_packing, op3_jaccard_join, op4_url_filter, op5_pii, op6_decontamination, op7_toxicity, op8_substring_dedup, op9_secrets, op10_embedding_dedup, op11_structure_repair, op12_sharding, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": OP3_SQL, "op4_url_filter": OP4_SQL, "op8_substring_dedup": OP8_SQL, "op13_prefix_trie": OP13_SQL}
