"""Quality rules: a threshold table compiled into one Spark projection.

Native: only built-in expressions, one pass, no shuffle. Every row is judged on its whole text.
Null or empty text has no words and fails the base rule. A text of any length is one row's work and is
held in memory while it is judged. Rows are judged one by one, so ties, repeated rows and extra columns
don't matter; an empty table gives an empty result. `quality_rules` and `measured` replace columns of the
input that have their results' names (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
base_failed, kept), and names that start with `_q_` are reserved; `keep_good` takes any names and returns
them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to a in is that it for on as with by was be at this from are an or he she they we you not have has had but "
    "le la les de des du un une et en que qui dans pour par sur au aux est pas ne se il elle avec ce son plus "
    "el los las del y es por para con una su al lo como más o pero sus ha "
    "der die das und zu den von mit ist im für auf nicht ein eine dem des sich auch als er sie es wird bei aus"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes where `low <= metric <= high`; a bound of None is open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The production thresholds; metrics are the keys of `ratios()`.
DEFAULT_RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("shout_ratio", None, 0.30),
    Rule("stop_ratio", 0.06, None),
    Rule("dup_line_ratio", None, 0.50),
)
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the columns
    `_q_stop`, `_q_shout` and `_q_lines` that the ratios use.

    Later steps name arrays of earlier ones more than once, so Catalyst keeps them as separate
    projections of one codegen stage rather than computing them again inside a lambda.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({
        "_q_words": F.array_remove(F.split(t, f"[{SPACE_CLASS}]+"), ""),
        "_q_lines_a": F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "_q_shout": F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long"),
    })
    words, lines = F.col("_q_words"), F.col("_q_lines_a")
    out = out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "_q_stop": F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))).cast("long"),
        "_q_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "_q_hash": F.transform(words, lambda w: F.xxhash64(w)),
    })
    hashes = F.col("_q_hash")
    first = F.size(hashes) - (WINDOW - 1)
    out = out.withColumn("_q_win", F.when(first >= 1, F.transform(F.slice(hashes, 1, first), lambda x, i: F.xxhash64(F.slice(hashes, i + 1, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    win = F.col("_q_win")
    out = out.withColumn("_q_sorted", F.when(F.size(F.array_distinct(win)) < F.size(win), F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.col("_q_sorted")
    seen = F.transform(pairs, lambda s, k: F.struct(s["i"].alias("i"), ((k > 0) & F.get(pairs, F.greatest(k - 1, F.lit(0)))["h"].eqNullSafe(s["h"]) | F.get(pairs, k + 1)["h"].eqNullSafe(s["h"])).alias("d")))
    at = F.sort_array(F.transform(F.filter(seen, lambda s: s["d"]), lambda s: s["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p"))
    covered = F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["p"])).alias("n"), i.alias("p")), lambda a: a["n"])
    return out.withColumn("n_repeat_words", F.coalesce(F.when(pairs.isNotNull(), covered), F.lit(0)).cast("long")).drop("_q_words", "_q_lines_a", "_q_hash", "_q_win", "_q_sorted")


def ratios() -> dict[str, Column]:
    """The metrics that rules may name, over the columns of `measured()`; 0 for texts without words."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("_q_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "shout_ratio": F.col("_q_shout") / n,
        "stop_ratio": F.col("_q_stop") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
    }


def compiled(rules=DEFAULT_RULES) -> Column:
    """One boolean expression of the whole table; an unknown metric is a KeyError."""
    known, ok = ratios(), F.lit(True)
    for r in rules:
        x = known[r.metric]
        if r.low is not None:
            ok = ok & (x >= F.lit(float(r.low)))
        if r.high is not None:
            ok = ok & (x <= F.lit(float(r.high)))
    return ok


def quality_rules(df: DataFrame, rules=DEFAULT_RULES, text: str = "text") -> DataFrame:
    """`df` with the five counts, base_failed and kept. base_failed: fewer than 20 words, or over 30 %
    of the words in repeated 8-word windows; kept: the base holds and every rule holds."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured(df, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(rules)).drop("_q_stop", "_q_shout", "_q_lines")


def keep_good(df: DataFrame, rules=DEFAULT_RULES, text: str = "text") -> DataFrame:
    """The rows of `df` that `quality_rules` keeps, with the columns of `df` and nothing else."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    inner = df.toDF(*names).withColumn("_text", F.col(names[df.columns.index(text)]))
    # Without the row number Catalyst would push the filter below the projections and write every
    # array expression out in it again and again; a projection that isn't deterministic stops that.
    judged = quality_rules(inner, rules, "_text").withColumn("_row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select(*names).toDF(*df.columns)
