"""Words of texts, and other string functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.session import text_batches


def _fold(t: str | None) -> str | None:
    return t and "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(_fold)


def folded(text: Column) -> Column:
    """Lower-cased, without diacritics; only texts beyond ASCII go through Python, since no built-in function takes marks off."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(_folded(F.when(~plain, text)))


@F.pandas_udf(StringType())
def title_key(text: pd.Series) -> pd.Series:
    """Titles that count as one: NFC and simple case folding."""
    return text.map(lambda t: None if t is None else "".join(c.casefold() if len(c.casefold()) == 1 else c for c in unicodedata.normalize("NFC", t)))


def words_of(text: Column) -> Column:
    """The tokens of a text: runs of letters, numbers and private-use characters of its folded form."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def split_words(text: str) -> list[str]:
    """words_of() for a text at hand, such as a query's words."""
    kept = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in _fold(text) or "")
    return kept.split()


def tokens(texts: DataFrame) -> DataFrame:
    """(ns, resource, path, pos, token): each token of each text field with its place in it, from 0.

    Where texts has `at`, the number of a value among several at its path, places of different values lie far apart.
    Texts are folded in batches of 512, since 10,000 long ones fill a worker's memory.
    """
    text_batches(texts.sparkSession)
    at = F.col("at").cast("long") if "at" in texts.columns else F.lit(0).cast("long")
    rows = texts.select("ns", "resource", "path", at.alias("_at"), F.posexplode(words_of(F.col("body"))).alias("_pos", "token"))
    return rows.select("ns", "resource", "path", (F.col("_at") * 2**32 + F.col("_pos")).alias("pos"), "token")


def contains_folded(text: Column, part: str) -> Column:
    """ASCII case-insensitive search for a part of a text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(text, upper, lower).contains(part.translate(str.maketrans(upper, lower)))


def repr_digest(content: Column) -> Column:
    """The digest header of some bytes."""
    return F.concat(F.lit("sha-256=:"), F.base64(F.unhex(F.sha2(content, 256))), F.lit(":"))


def duration_seconds(text: str) -> float:
    """Seconds of an ISO 8601 duration of weeks, or of days, hours, minutes and seconds."""
    import re

    if not (m := re.fullmatch(r"P(?=.)(?:(\d+)W|(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?)", text)):
        raise ValueError(f"not a duration: {text}")
    return sum(float(v or 0) * u for v, u in zip(m.groups(), (604800, 86400, 3600, 60, 1), strict=True))


def duration_column(text: Column) -> Column:
    """duration_seconds() of a column of texts; null where a text isn't such a duration."""
    form = r"^P(?=.)(?:([0-9]+)W|(?:([0-9]+)D)?(?:T(?=.)(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?)\z"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, form, k), F.lit("")).cast("double"), F.lit(0.0))
    total = part(1) * 604800 + part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    return F.when(text.rlike(form), total)


def canonical_url(url: Column) -> Column:
    """A url under which equal queries are one: its parameters sorted, distinct and strictly percent-encoded.

    Parameters are what & separates; a url without a query stays as it is.
    """
    strict = lambda t: F.replace(F.replace(F.replace(F.url_encode(F.url_decode(t)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    base, query = F.substring_index(url, "?", 1), F.regexp_extract(url, r"(?s)\?(.*)$", 1)
    pair = lambda p: F.concat(strict(F.substring_index(p, "=", 1)), F.lit("="), strict(F.when(p.contains("="), F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).otherwise("")))
    pairs = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)))
    return F.when(url.contains("?"), F.concat_ws("?", base, F.nullif(F.array_join(pairs, "&"), F.lit("")))).otherwise(url)
