"""URL filtering with redirect equivalence.

Rules judge a url by its host and path. Redirects and canonical links make pages aliases of each other; a block that a
rule gives to one of them holds for all its aliases that no rule names, unless a rule allows one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.text import ascii_lower, durable

#: Fixed values: (verdict, host, path prefix).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fitting(host: Column, path: Column, rules) -> Column:  # noqa: ANN001
    """The longest rule that fits as (verdict, rule), or null; a rule is written as host and path without the first slash."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    # The longest comes first, so it is the outermost condition; of equal length only one can fit, or they are the same.
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """The key under which urls are the same resource: host, path and query, without scheme and fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.xxhash64(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), query)


def _tags(html: Column) -> Column:
    # A > within quotes doesn't end a tag.
    return F.regexp_extract_all(html, F.lit(r"""(?is)<(?:link|meta)\b[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(F.trim(F.regexp_replace(value, "^[\"']|[\"']$", "")), "&amp;", "&")


def _without_dots(url: Column) -> Column:
    """url with its path's . and .. segments taken out."""
    head, tail = F.regexp_extract(url, r"(?s)^([^?#]*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1)
    parts = F.split(path_of(url), "/")
    step = lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(p)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1)
    return F.when(path_of(url).contains("/."), F.concat(head, F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""), tail)).otherwise(url)


def resolved(target: Column, base: Column) -> Column:
    """target as an absolute url, seen from base: absolute, //host, /path and relative forms; null for other schemes.

    Segments . and .. are taken out. A page's own <base> is not heeded.
    """
    scheme = F.regexp_extract(base, r"(?s)^([^:/?#]*):", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return _without_dots(
        F.when(target.rlike(r"^(?i)https?://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when((target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("?"), F.concat(root, path_of(base), target))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target): what pages name as their canonical url (link rel=canonical) or redirect to (meta refresh).

    Pages without either, without a url or without html give none. Targets are resolved against the page's url.
    """
    # The plain search spares most pages the patterns.
    lower = F.lower(F.col(html_col))
    rows = pages.where(F.col(url_col).contains("://") & (lower.contains("canonical") | lower.contains("refresh"))).select(F.col(url_col).alias("url"), F.explode(_tags(F.col(html_col))).alias("tag"))
    rows = rows.select("url", "tag", F.lower(F.substring("tag", 2, 4)).alias("kind"))
    rows = rows.select(
        "url",
        F.when((F.col("kind") == "link") & F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical"), _attribute(F.col("tag"), "href"))
        .when((F.col("kind") == "meta") & (F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh"), F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?(.*)$", 1))
        .alias("target"),
    )
    rows = rows.select("url", F.trim(F.regexp_replace("target", "^[\"']|[\"']$", "")).alias("target"))
    # Written before anything filters them, or the optimiser would spell the patterns out in every condition.
    found = durable(rows.select("url", resolved(F.col("target"), F.col("url")).alias("target")))
    return found.where("target is not null").distinct()


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:  # noqa: ANN001
    """One row per row of pages: (id_col, host, path, rule, verdict, alias).

    verdict is that of the longest rule that fits the url; such a rule is explicit and holds whatever the aliases say.
    A url that no rule fits takes on its aliases' verdict: allow if a rule allows one of them, else block if a rule
    blocks one, else allow. Aliases are the connected component of the url under redirects (url, target; optional),
    canonical links and meta refreshes of the pages' html (none if html_col is None); urls that differ by scheme, host
    case or fragment only are one. Targets that are no pages count, too, since they are judged by their url. alias is the component's verdict, or null if it has none.

    Null urls and those without :// have empty host and path, no rule and no aliases: allow. Repeated rows are judged
    alike, other columns aren't read, and an empty table gives an empty one. Only linked urls take part in the
    components; verdicts come back by one join on the url's key, and a host, however frequent, is never a key.
    """
    url = F.col(url_col)
    links = alias_links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        given = redirects.select("url", "target")
        links = given if links is None else links.union(given)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("_node"))
    rows = rows.withColumn("_own", _fitting(F.col("host"), F.col("path"), rules))
    if links is None:
        return rows.select(id_col, "host", "path", F.col("_own.rule").alias("rule"), F.coalesce("_own.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias"))
    links = durable(links.where(F.col("url").contains("://") & F.col("target").contains("://")))
    joined = durable(components(links.select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v"))))
    ends = links.select(F.explode(F.array("url", "target")).alias("url")).select(node_of(F.col("url")).alias("node"), _fitting(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("said"))
    said = ends.join(joined, "node").groupBy("root").agg(F.when(F.max(F.col("said") == "allow"), "allow").when(F.max(F.col("said") == "block"), "block").alias("alias"))
    of = joined.join(said, "root").select("node", "alias").where("alias is not null")
    out = rows.join(of, F.col("_node") == F.col("node"), "left")
    return out.select(id_col, "host", "path", F.col("_own.rule").alias("rule"), F.coalesce("_own.verdict", "alias", F.lit("allow")).alias("verdict"), "alias")
