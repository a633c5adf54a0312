"""Mixing sources to target weights by a temperature, realised as budgeted block permutations.

A source with `t` tokens gets the weight t^a / sum t^a. The exponent `a` in [0, 1] is bisected on a
dyadic grid: the largest with at least the target entropy, raised where needed until no source is
repeated more than `max_repeats` times (a = 1, natural shares, if nothing less satisfies the limit).
Each source's quota floor(weight * budget) is filled by whole permutations of its documents (blocks
0, 1, ...) and by the head of one more permutation.

Native: aggregates, joins and windows only. Documents of a source are never brought together: sums
by hash range find the document at which the last block ends, range by range, so a source that holds
a third of all rows costs no more per task than any other. The driver sees a few scalars.

Tokens are counted by `token_estimate`, or taken from a column that holds counts (those of token_count).

Null source: the source named ''. Null or empty text: no tokens; such documents come with every
whole block and with the head as far as it reaches. Rows with equal doc_id in one source share a
place in the permutation and stay together. A source without any token has no share: none of its
documents comes out, and it doesn't count among the sources. An empty table gives an empty result. Long
texts only count; a text is never split. Extra columns pass; columns of the input that are called mix_block or
mix_key are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, saved

LEVELS, PER_JOB, SEED = 16, 4, 17
#: Below this many sources the table of quotas is broadcast (under 100 bytes a row).
BROADCAST_SOURCES = 100_000
#: Bits of the permutation key that each narrowing step looks at, from the top of 60.
STEP_BITS = 12


def token_estimate(text: Column) -> Column:
    """Tokens of a byte-level vocabulary, roughly: four bytes each, but one for each word at least; none without
    words. So languages written without spaces, or in several bytes a letter, weigh what they cost."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")).cast("long")
    return F.when(words > 0, F.greatest(words, F.floor((F.octet_length(text) + 3) / 4).cast("long"))).otherwise(F.lit(0).cast("long"))


def permutation_key(seed: int, source: Column, block: Column, doc_id: Column) -> Column:
    """60 bits that put a source's documents in the order of one block."""
    text = F.concat_ws("|", F.lit(str(seed)), source, block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def with_blocks(df: DataFrame, *, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of a mixture that has lost its mix_block and mix_key, with them: the copies of a document are told
    apart by number, copy n being block n's. Sorted by these columns, rows stand in the order of the blocks."""
    src = F.coalesce(F.col(source), F.lit(""))
    copy = Window.partitionBy(F.col(doc_id), src, F.xxhash64(F.col(text))).orderBy(F.lit(0))  # a document's copies
    out = df.withColumn("mix_block", (F.row_number().over(copy) - 1).cast("long"))
    return out.withColumn("mix_key", permutation_key(seed, src, F.col("mix_block"), F.col(doc_id)))


def exponent(sources: DataFrame, budget: int, entropy_share: float, max_repeats: float) -> float:
    """Both bisections, PER_JOB levels to a job: each job aggregates the midpoints of the whole
    subtree below the present bounds, and the driver walks it."""
    log_t = F.log(F.col("tokens").cast("double"))
    n, least = sources.agg(F.count("*"), F.min("tokens")).first()
    if not n:
        return 1.0
    target = entropy_share * math.log(n)
    bounds = {"entropy": (0.0, 1.0), "repeats": (0.0, 1.0)}
    steps = 2**PER_JOB
    for _ in range(LEVELS // PER_JOB):
        mids = {(k, i): lo + (hi - lo) * i / steps for k, (lo, hi) in bounds.items() for i in range(1, steps)}
        got = sources.agg(*[f for (k, i), a in mids.items() for f in (F.sum(F.exp(log_t * a)).alias(f"z_{k}_{i}"), F.sum(F.exp(log_t * a) * log_t).alias(f"s_{k}_{i}"))]).first()
        for k, (lo, hi) in bounds.items():
            left, right = 0, steps
            while right - left > 1:
                i = (left + right) // 2
                a, z = mids[k, i], got[f"z_{k}_{i}"]
                if k == "entropy":
                    up = math.log(z) - a * got[f"s_{k}_{i}"] / z >= target
                else:
                    up = least ** (a - 1) * budget / z > max_repeats
                left, right = (i, right) if up else (left, i)
            bounds[k] = (lo + (hi - lo) * left / steps, lo + (hi - lo) * right / steps)
    # the grid's ends count as well: 1 if even that is diverse enough, 0 if no repeat is too many
    natural = sources.agg(F.sum("tokens"), F.sum(F.col("tokens") * log_t)).first()
    by_entropy = 1.0 if math.log(natural[0]) - natural[1] / natural[0] >= target else bounds["entropy"][0]
    by_repeats = 0.0 if budget / (n * least) <= max_repeats else bounds["repeats"][1]
    return max(by_entropy, by_repeats)


def mixing_plan(narrow: DataFrame, seed: int, budget_tokens: int | None, entropy_share: float, max_repeats: float) -> DataFrame:
    """One row per source: source, tokens, weight, quota, blocks (whole permutations), cut (the last
    permutation key that block number `blocks` takes; null if it takes none).

    narrow: source, doc_id, n_tokens."""
    spark = narrow.sparkSession
    sources = saved(narrow.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "sources")
    budget = budget_tokens if budget_tokens is not None else int(sources.agg(F.sum("tokens")).first()[0] or 0)
    a = exponent(sources, budget, entropy_share, max_repeats)
    log_t = F.log(F.col("tokens").cast("double"))
    z = sources.agg(F.sum(F.exp(log_t * a))).first()[0] or 1.0
    plan = sources.withColumn("weight", F.exp(log_t * a) / F.lit(z)).withColumn("quota", F.floor(F.col("weight") * F.lit(budget)).cast("long"))
    plan = plan.withColumn("blocks", F.expr("quota div tokens")).withColumn("rest", F.expr("quota - blocks * tokens"))
    n_sources = sources.count()
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)
    keyed = saved(narrow.join(small(plan.where("rest > 0").select("source", "blocks", "rest")), "source").select("source", "n_tokens", "rest", permutation_key(seed, F.col("source"), F.col("blocks"), F.col("doc_id")).alias("key")), "mix-keys")
    # Twice: sums by the next 12 bits of the key, and the one range of each source where its rest runs
    # out; then the documents of that range alone, a 2^-24 part of the source.
    shift = 60
    for _ in range(2):
        shift -= STEP_BITS
        part = F.expr(f"shiftright(key, {shift})")
        sums = keyed.groupBy("source", part.alias("part"), "rest").agg(F.sum("n_tokens").alias("n"))
        before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        edge = sums.withColumn("before", before).where("before < rest and before + n >= rest").select(F.col("source").alias("_source"), F.col("part").alias("_part"), (F.col("rest") - F.col("before")).alias("_rest"))
        keyed = keyed.join(small(edge), (F.col("source") == F.col("_source")) & (part == F.col("_part"))).select("source", "n_tokens", F.col("_rest").alias("rest"), "key")
    by_key = keyed.groupBy("source", "key", "rest").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    cut = by_key.withColumn("before", before).where("before < rest").groupBy("source").agg(F.max("key").alias("cut"))
    return saved(plan.join(cut, "source", "left").select("source", "tokens", "weight", "quota", "blocks", "cut"), "mix-plan") if n_sources else spark.createDataFrame([], "source string, tokens long, weight double, quota long, blocks long, cut long")


def mix_sources(df: DataFrame, *, source: str = "source", doc_id: str = "doc_id", text: str = "text", tokens: str | None = None, seed: int = SEED, budget_tokens: int | None = None, entropy_share: float = 0.95, max_repeats: float = 4.0) -> DataFrame:
    """The rows of `df`, each once for every block that takes it, with `mix_block` and `mix_key`
    (ascending mix_key within (source, mix_block) is the block's order) added. Extra columns pass.

    tokens: a column of token counts to weigh by (null: 0); `token_estimate` of the text if none is named.
    budget_tokens: tokens to hand out over all sources; as many as there are if None.
    entropy_share: least entropy of the weights, as a share of that of equal weights.
    """
    df = df.drop("mix_block", "mix_key")
    names = [f"_c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    inner = df.toDF(*names).withColumn("_source", F.coalesce(F.col(at[source]), F.lit("")))
    narrow = saved(inner.select(F.col("_source").alias("source"), F.col(at[doc_id]).alias("doc_id"), (F.coalesce(F.col(at[tokens]).cast("long"), F.lit(0)) if tokens else token_estimate(F.col(at[text]))).alias("n_tokens")), "mix-narrow")
    plan = mixing_plan(narrow, seed, budget_tokens, entropy_share, max_repeats).select(F.col("source").alias("_source"), F.col("blocks").alias("_blocks"), F.col("cut").alias("_cut"))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    out = inner.join(plan, "_source").withColumn("_block", F.explode(F.expr("sequence(0L, _blocks)")))
    out = out.withColumn("_key", permutation_key(seed, F.col("_source"), F.col("_block"), F.col(at[doc_id])))
    out = out.where((F.col("_block") < F.col("_blocks")) | (F.col("_key") <= F.col("_cut")))
    return out.select(*[F.col(n).alias(c) for c, n in at.items()], F.col("_block").alias("mix_block"), F.col("_key").alias("mix_key"))
