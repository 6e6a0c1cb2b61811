"""Quality rules: a table of thresholds compiled into projections of built-in functions only.

A text's words are its runs of characters other than white space. A null or empty text has no words; every ratio over
no words or no lines is null, a null ratio passes no rule, so such texts are not kept. Repeated rows are judged alike,
ids may be null, and other columns of the input are not looked at. The cost per row is n log n in its words, so very
long texts need no cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r" \t\n\x0B\f\r"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"

#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you "
    "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais me ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch sein sich sie sind um und von vor war wie wir zu zum zur über "
    "al como con del el ella esta este fue ha hay la las lo los más muy no o para pero por que se sin sobre su sus un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; the measure is a SQL expression over MEASURES."""

    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")


#: The default table. Ratios are of words, lines or characters without white space.
RULES = (
    Rule("enough_words", "n_words", 50),
    Rule("word_length", "word_chars / n_words", 2.5, 10.5),
    Rule("symbols", "n_symbols / n_words", high=0.10),
    Rule("stop_words", "n_stop / n_words", 0.06),
    Rule("letters", "n_letters / word_chars", 0.70),
    Rule("capitals", "n_capitals / n_letters", high=0.30),
    Rule("shouts", "n_shouts / n_words", high=0.10),
    Rule("repeated_lines", "n_dup_lines / n_lines", high=0.40),
    Rule("repeated_windows", "n_repeat_words / n_words", high=0.30),
    Rule("ellipses", "n_ellipsis_lines / n_lines", high=0.30),
    Rule("bullets", "n_bullet_lines / n_lines", high=0.90),
)


def _count(text: Column, pattern: str) -> Column:
    """Code points that a one-character pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _like(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda line: line.rlike(pattern))).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and every count the rules may use: n_words, word_chars, n_symbols, n_letters, n_capitals, n_shouts, n_stop,
    n_lines, n_dup_lines, n_bullet_lines, n_ellipsis_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.btrim(text, F.lit(BLANKS)).alias("bare"))
    second = first.select(
        "doc_id", "text",
        F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", f"[{WHITE}]+")).alias("words"),
        F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.filter(F.split("text", "\n"), lambda s: s.rlike(f"[^{WHITE}]"))).alias("lines"),
    )
    n = F.size("words")
    third = second.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        (F.length("text") - F.length(F.regexp_replace("text", f"[{WHITE}]+", ""))).alias("blanks"),
        F.length("text").alias("chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{L}+", ""))).cast("long").alias("n_letters"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        _count(F.col("text"), "!").alias("n_shouts"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _like(F.col("lines"), r"^\s*[-*•·]").alias("n_bullet_lines"),
        _like(F.col("lines"), r"(\.\.\.|…)\s*$").alias("n_ellipsis_lines"),
        F.when(n < 4, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
        ).alias("windows"),
    )
    # only texts with an equal pair of windows need their places, in the order of the windows' hashes
    fourth = third.withColumn(
        "placed",
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ),
    )
    fifth = fourth.withColumn(
        "places",
        F.sort_array(F.transform(
            F.filter("placed", lambda x, k: (F.get("placed", k - 1)["h"] == x["h"]) | F.coalesce(F.get("placed", k + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        )),
    )
    covered = F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - p, F.lit(3))))
    return fifth.select(
        "doc_id", "n_words", (F.col("chars") - F.col("blanks")).cast("long").alias("word_chars"), "n_symbols", "n_letters", "n_capitals", "n_shouts", "n_stop",
        "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines",
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """True where every rule passes."""
    out = F.lit(True)
    for rule in rules:
        value = F.expr(f"try_divide({rule.measure.replace(' / ', ', ')})" if " / " in rule.measure else rule.measure).cast("double")
        out = out & F.coalesce((value >= rule.low) & (value <= rule.high), F.lit(False))
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of each row, base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = measures(docs, id_col, text_col)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
