"""URL block and allow rules with redirect equivalence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, text_or_empty

#: An attribute value in double quotes, in single quotes or bare.
VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
CANONICAL_TAG = r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"
REFRESH_TAG = r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\s\"'>]+)"
TO_URL = r"(?is)\burl\s*=\s*[\"']?([^\s\"'>]+)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where :// is absent."""
    rest = F.regexp_extract(text_or_empty(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty for null or where :// is absent."""
    return F.regexp_extract(text_or_empty(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (action, host and path as one string) that fits, as a struct, or null."""
    out = None
    for action, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<rule:string,action:string>") if out is None else out


def resolve(link: Column, base: Column) -> Column:
    """An absolute form of a link on a page: absolute, scheme-relative, root-relative or relative to the folder."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*/(?:[^?#]*/)?)", 1)
    folder = F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder)
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def key_of(url: Column) -> Column:
    """A url without its fragment, which never reaches a server, and with its scheme and host in lower case."""
    whole = F.split_part(url, F.lit("#"), F.lit(1))
    head = F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.lower(head), F.substr(whole, F.length(head) + 1))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) url keys: a page and the target of its canonical link, or of its meta refresh."""
    html = text_or_empty("html").alias("html")
    pages = pages.where("url is not null").select("url", html)
    lower = F.lower("html")
    pages = pages.where(lower.contains("canonical") | lower.contains("refresh"))
    links = F.array(
        F.regexp_extract(F.regexp_extract("html", CANONICAL_TAG, 1), HREF, 1),
        F.regexp_extract(F.regexp_extract("html", REFRESH_TAG, 1), TO_URL, 1),
    )
    found = pages.select("url", F.explode(links).alias("link")).where("link <> '' and url like '%://%'")
    link = F.replace(F.col("link"), F.lit("&amp;"), F.lit("&"))
    return found.select(key_of(F.col("url")).alias("a"), key_of(resolve(link, F.col("url"))).alias("b")).where("a <> b")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict.

    A page that a rule fits takes the verdict of its longest rule. Urls that redirects (an optional table of
    from_url, to_url), meta refreshes or canonical links join are aliases; components of these edges are found with
    distributed star rounds, link targets that are no pages themselves included. A page without a rule of its own
    takes ``allow`` if a rule allows some alias, else ``block`` if a rule blocks some alias, else ``allow``.

    ``rules`` is a short list kept in the query itself. Null or empty urls have empty host and path and no rule, so
    they are allowed; repeated pages are judged each; null html has no links; other columns are ignored.
    """
    edges = link_edges(pages)
    if redirects is not None:
        given = redirects.select(key_of(F.col("from_url")).alias("a"), key_of(F.col("to_url")).alias("b"))
        edges = edges.unionByName(given.where("a <> b"))
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    roots = connected_components(edges)
    own = rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)
    ruled = roots.select("root", own["action"].alias("action")).groupBy("root").agg(
        F.max(F.coalesce(F.col("action") == "allow", F.lit(False))).alias("allowed"),
        F.max(F.coalesce(F.col("action") == "block", F.lit(False))).alias("blocked"),
    )
    aliased = roots.join(ruled.where("blocked and not allowed").select("root"), "root").select(F.col("node").alias("_key"), F.lit("block").alias("_alias"))
    return (
        judged.withColumn("_key", key_of(F.col("url")))
        .join(aliased, "_key", "left")
        .select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.action", "_alias", F.lit("allow")).alias("verdict"))
    )
