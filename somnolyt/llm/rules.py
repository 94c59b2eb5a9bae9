"""Quality rules [native]: a threshold table compiled into one projection.

Every metric is a DataFrame expression over one row, so there is no shuffle,
no user function and no state: the operator is a single projection over the
scan and its work is proportional to the text.

Defined results: null text counts as empty (no words, ``base_failed``); rows
are judged one by one, so repeated rows and null ids keep their own result;
an empty table gives an empty result; extra input columns are ignored and
cannot clash, since only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import GAP, let

#: Fixed values of the contract.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Common function words of the languages served (public lists).
STOP_WORDS = (
    "the of and to in is that it for on with as was by be at this from are or an "
    "de la que el en y a los se del las un por con no una su para es al "
    "le et les des du une est pour qui dans par sur au avec pas "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a row while ``low <= metric <= high`` (an open end: None)."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table.  A row passes when every rule holds.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_share", 0.02, None),
    Rule("dup_line_share", None, 0.6),
    Rule("upper_share", None, 0.5),
)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by 8-word windows that occur at least twice in the text.

    Windows are compared by a 64-bit hash of their words: two of the windows
    of one text collide with odds of about n^2 / 2^65."""
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                             lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
                    ).otherwise(F.array().cast("array<bigint>"))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
                         | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        return F.aggregate(
            starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n")),
            lambda acc: acc["n"])

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, covered)).otherwise(F.lit(0).cast("long"))

    return let(hashes, count)


def counts(text: Column) -> Column:
    """Struct of the integer counts of one text."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        words = F.filter(F.split(t, GAP), lambda w: w != "")

        def with_words(w: Column) -> Column:
            n = F.size(w)
            return let(lines, lambda ls: F.struct(
                n.cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(w, n).cast("long").alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(F.filter(w, lambda x: x.rlike("^[A-Z]{2,}"))).cast("long").alias("n_upper_words")))
        return let(words, with_words)
    return let(text, of)


def metrics() -> dict[str, Column]:
    """Ratios the threshold table refers to, from the counts' columns."""
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / per_word,
        "symbols_per_word": F.col("n_symbols") / per_word,
        "stop_word_share": F.col("n_stop_words") / per_word,
        "upper_share": F.col("n_upper_words") / per_word,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column that is true where every rule of the table holds."""
    known = metrics()
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (known[rule.metric] >= F.lit(rule.low))
        if rule.high is not None:
            verdict = verdict & (known[rule.metric] <= F.lit(rule.high))
    return verdict


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, the base verdict and the threshold table's verdict of each row."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    counted = docs.select("doc_id", counts(F.col("text")).alias("c")).select("doc_id", "c.*")
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lines", "n_stop_words", "n_upper_words",
        base.alias("base_failed"), (~base & compile_rules(rules)).alias("kept"))
