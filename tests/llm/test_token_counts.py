"""Counts against the tokenizers library's own unigram model."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from tallyloom.llm import queries, token_counts
from tallyloom.llm.queries import tokenizer_path


def library(pieces):
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")])
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


SMALL = [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("ba", -2.0), ("aba", -3.0), ("abab", -4.0), ("bb", -1.5), ("é", -2.5), ("▁ab", -3.0)]
# the library reckons the cost of unknown characters from all scores, the unknown piece's included
REAL = token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé xy\n\t\x1c ", max_size=24))
def test_ties(text):
    assert token_counts.Counter(SMALL).count(text)[0] == library(SMALL)(text)


def test_real():
    counter, want = token_counts.Counter(REAL), library(REAL)
    for t in ["Hello world, this is it.", "naïve Übermut 123,456 日本語テキスト", "", "  ", "x" * 500, "a b　c", "🙂🙂 ok 🙂", "the " * 50]:
        assert counter.count(t)[0] == want(t), t


def test_whole_table(spark):
    """op1 on all documents against the library's own counts."""
    sf, want = "/root/testdata/sf0.001", library(REAL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op1_token_counts(spark, sf).collect()} == {d: want(t or "") for d, t in texts.items()}


def test_long_words():
    counter = token_counts.Counter(SMALL)
    for word in ("ab" * 600 + "xyé" * 100, "x" * 3000):
        assert counter.count(word)[0] == library(SMALL)(word) and word not in counter


def test_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (2, "ab " * 40000), (3, "ab" * 20000), (3, "ab" * 20000)], "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    out = token_counts.count(docs, pieces=SMALL).collect()
    assert len(out) == 5 and {r["n_tokens"] for r in out if r["doc_id"] == 1} == {0}
    assert max(r["n_words"] for r in out) == 40000 and math.isfinite(sum(r["n_tokens"] for r in out))
    assert token_counts.count(docs.limit(0), pieces=SMALL).count() == 0
