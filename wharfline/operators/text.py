"""Tokenisers, word counts and pattern searches as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased words, cut at runs of non-word characters; no empty ones."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda x: x != "")


def split_words(text: Column) -> Column:
    """The same pieces with the empty ones, for ``exploded`` to drop."""
    return F.split(F.lower(text), r"\W+")


def tokens_with_empty(text: Column) -> Column:
    """The same, keeping a leading empty word; trailing ones go, and of a text without any word so does the last.

    An empty text has one empty word.
    """
    parts = F.split(F.lower(text), r"\W+")
    has_word = text.rlike(r"\w")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array(F.lit(""))).when(has_word, kept).otherwise(F.array().cast("array<string>"))


def space_tokens(text: Column) -> Column:
    return F.split(text, " ")


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line, with its number from 1."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(*keep, (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def exploded(df: DataFrame, words: Column, keep_empty: bool = False) -> DataFrame:
    """A row per word. Empty words go after the explode, in generated code."""
    out = df.select(F.explode(words).alias("word"))
    return out if keep_empty else out.where("word <> ''")


def word_count(df: DataFrame, words: Column, keep_empty: bool = False) -> DataFrame:
    """Hash aggregates before and after one exchange by word."""
    return exploded(df, words, keep_empty).groupBy("word").agg(F.count("*").alias("n"))


def word_count_without_combiner(df: DataFrame, words: Column) -> DataFrame:
    """All occurrences cross the exchange, none summed before it."""
    return exploded(df, words).repartition("word").groupBy("word").agg(F.count("*").alias("n"))


def grep(df: DataFrame, line: str, patterns: Mapping[str, str]) -> DataFrame:
    """Rows whose ``line`` a pattern is found in, once per such pattern.

    One scan serves all patterns. Null and empty lines never match.
    """
    hits = F.array(*[F.when(F.col(line).rlike(p), F.lit(name)) for name, p in patterns.items()])
    kept = df.where(F.col(line).isNotNull() & (F.col(line) != ""))
    return kept.withColumn("pattern", F.explode(F.array_compact(hits)))


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def mixed_tokens(line: Column) -> Column:
    """Tokens as structs (tag, i, s): whole numbers as ints, those too large as 0."""
    digits = lambda x: x.rlike(r"^-?[0-9]+$")
    parts = F.filter(F.split(line, r"\W+"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            F.when(digits(x), "i").otherwise("s").alias("tag"),
            F.when(digits(x), F.coalesce(x.try_cast("int"), F.lit(0))).alias("i"),
            F.when(~digits(x), x).alias("s"),
        ),
    )


def pipe(df: DataFrame, text: str, command: str) -> DataFrame:
    """The lines that a process per partition answers to the lines of ``text``."""
    from pyspark.sql import Row

    lines = df.select(F.coalesce(F.col(text), F.lit(""))).rdd.map(lambda r: r[0]).pipe(command)
    return df.sparkSession.createDataFrame(lines.map(lambda x: Row(value=x)), "value string")


def parse_metrics(df: DataFrame, line: str) -> DataFrame:
    """(host, latency, rate) of log lines; what a line doesn't tell is null."""
    found = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    return df.select(
        F.regexp_extract(line, r"^(\S+)", 1).alias("host"),
        found(r"Latency ([0-9]+) ms").cast("bigint").alias("latency"),
        found(r"That's ([0-9.]+) elements/second/core").cast("double").alias("rate"),
    )
