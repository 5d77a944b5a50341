"""Small column helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import durable as durable
from palimpsest.session import text_batches as text_batches

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spaced(text: Column) -> Column:
    """The words of a text with one space between them; null stays null."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def n_spaced(words: Column) -> Column:
    """Number of words in what spaced() returns."""
    return F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


#: Rows of a few numbers (50 bytes, about) that are broadcast at most: 20 MB.
MOST_BROADCAST = 400_000


def checked(table: DataFrame, weight: Column | None = None) -> DataFrame:
    """A written table, marked for broadcast if it is counted to hold no more than MOST_BROADCAST narrow rows.

    weight: how many narrow rows a row stands for (its array's length). A larger table is joined by a shuffle.
    """
    n = table.agg(F.sum(weight if weight is not None else F.lit(1))).first()[0] or 0
    return F.broadcast(table) if n <= MOST_BROADCAST else table


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
