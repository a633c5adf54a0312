"""Every operator on empty tables, very long texts, repeated rows, and columns whose names clash with its own."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, decontaminate, licenses, line_dedup, mixing, near_dup, quality, token_count, token_records, warc

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use inside, or return.
CLASHES = "key doc n rep size bucket kept n_words mix_block mix_key unit words raw own license grams hits part shard score item_id component_id _c0 _k0 _source _block digest first rank n_tokens offset path label set_key t u v x turn role conv_id page_id html at node a b block last chunk spans".split()
LONG = ("the cat and a dog went to sea in it " * 9 + "by day\n") * 6000  # over 2 MB


def benchmark(spark):
    return spark.createDataFrame([(1, "Which of the rivers named here is the longest one of all?")], "item_id long, text string")


def records(df):
    return token_records.read_token_records(token_records.write_token_records(df, WORDS))


OPERATORS = {
    "mixing": (lambda df: mixing.mix_sources(df), None),
    "token_count": (lambda df: token_count.token_counts(df, BYTES), 5),
    "line_dedup": (lambda df: line_dedup.dedup_lines(df), 5),
    "quality": (lambda df: quality.quality_rules(df), 5),
    "keep_good": (lambda df: quality.keep_good(df), None),
    "near_dup": (lambda df: near_dup.near_duplicates(df), 5),
    "keep_representatives": (lambda df: near_dup.keep_representatives(df), None),
    "licenses": (lambda df: licenses.scan_licenses(df), 0),
    "notices": (lambda df: licenses.find_notices(df), 0),
    "decontaminate": (lambda df: decontaminate.contaminated(df, benchmark(df.sparkSession)), 0),
    "keep_clean": (lambda df: decontaminate.keep_clean(df, benchmark(df.sparkSession)), 5),
    "token_records": (records, 5),
}
KEEPS_COLUMNS = {"keep_good", "keep_representatives", "keep_clean"}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, LONG, "a"), (2, "short and the text of it", "a"), (2, "short and the text of it", "a"), (3, None, None), (None, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(odd, name):
    run, n = OPERATORS[name]
    out = run(odd)
    got = out.count()
    assert n is None or got == n
    if name in KEEPS_COLUMNS:
        assert out.columns == odd.columns
        assert out.agg(F.count_distinct("key")).first()[0] <= 1 and (got == 0 or out.first()["key"] == "extra key")
    assert run(odd.limit(0)).count() == 0


def test_mixing_replaces_its_own_columns(odd):
    out = mixing.mix_sources(odd)
    assert [c for c in out.columns if c.startswith("mix_")] == ["mix_block", "mix_key"] and dict(out.dtypes)["mix_block"] == "bigint"
    by_count = mixing.mix_sources(odd.withColumn("n_tokens", F.lit(7)), tokens="n_tokens")
    assert {r.source for r in by_count.select("source").distinct().collect()} == {"a", "b", None}


def test_pages(spark):
    rows = [(1, "u", LONG), (2, "u", LONG), (2, "u", LONG), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in ("page_id", "html")])
    got = warc.read_warc(warc.write_warc(df), split=1000)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got.collect()) == [(0, "response", None), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1)]
    assert got.where("page_id = 1").first().payload == LONG.encode()
    empty = warc.write_warc(df.limit(0))
    assert warc.read_warc(empty).count() == 0 and warc.skipped_bytes(empty, warc.read_warc(empty)).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG), (1, 1, "assistant", LONG), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in ("conv_id", "turn", "role")])
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {1: (3, 2 * len(LONG)), None: (1, 0)}
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
