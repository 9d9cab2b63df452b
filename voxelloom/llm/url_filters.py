"""URL rules with redirect equivalence, native.

A rule (host, path, action) fits a url whose host is the rule's or below it and
whose path starts with the rule's; the longest rule decides. Urls that lead to
the same page form a class: urls alike but for scheme, fragment, dot segments, a
final slash and tracking parameters, and those that canonical links, refresh
redirects or a given table of redirects connect. All links of a page count,
resolved against its base; those inside comments don't. A url without a rule is blocked if a member
of its class is blocked by a rule, and allowed otherwise. A url's own allow
rule always takes precedence over its class.

Null urls and urls without `://` have an empty host and path, no rule and no
class: they are allowed. Null html has no links, and neither do targets of other
schemes than those with `://`. A tag ends at its first `>`. Repeated rows are judged alike.
An empty table gives an empty result. Other columns are ignored. Rules become
one expression, so they should be thousands at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, durable, lookup

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

SCHEME_OF = r"(?s)^(.*?)://"
AFTER_SCHEME = r"(?s)^.*?://(.*)$"
HOST = r"^[^/?#]*"
PATH = r"(?s)^[^/?#]*([^?#]*)"
QUERY = r"(?s)^[^?#]*\?([^#]*)"
#: Parameters that say how a visitor came, not what the page is.
TRACKING = r"^(utm_[^=]*|gclid|fbclid)(=.*)?$"
COMMENT = r"(?s)<!--.*?(-->|\z)"
CANONICAL = r"""(?is)<link\b[^>]*[\s"'/]rel\s*=\s*("[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*[\s"'/]http-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""
BASE = r"(?is)<base\b[^>]*>"
HREF = r"""(?is)[\s"'/]href\s*=\s*("[^">]*"|'[^'>]*'|[^\s"'>]+)"""
CONTENT = r"""(?is)[\s"'/]content\s*=\s*("[^">]*"|'[^'>]*'|[^\s"'>]+)"""
#: What a refresh's content says after the delay.
TARGET = r"""(?is)^\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)?["']?([^"']*)"""
AMPERSAND = r"(?i)&(amp|#38|#x26);"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def with_parts(rows: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Adds scheme, host, path and query of a url column, each empty where there is
    none. Later steps read these columns; nothing is parsed twice."""
    whole = F.coalesce(F.when(F.col(url).contains("://"), F.col(url)), F.lit(""))
    rows = rows.withColumns({f"{prefix}scheme": F.regexp_extract(whole, SCHEME_OF, 1), f"{prefix}rest": F.regexp_extract(whole, AFTER_SCHEME, 1)})
    rest = F.col(f"{prefix}rest")
    rows = rows.withColumns({
        f"{prefix}host": ascii_lower(F.regexp_extract(rest, HOST, 0)),
        f"{prefix}path": F.regexp_extract(rest, PATH, 1),
        f"{prefix}query": F.regexp_extract(rest, QUERY, 1),
    })
    return rows.drop(f"{prefix}rest")


def undotted(path: Column) -> Column:
    """A path without `.` and `..` segments."""
    step = lambda done, part: F.when(part == ".", done).when(part == "..", F.regexp_replace(done, r"/[^/]*\z", "")).otherwise(F.concat(done, F.lit("/"), part))
    folded = F.aggregate(F.slice(F.split(path, "/", -1), 2, 1 << 30), F.lit(""), step)
    return F.when(path.rlike(r"/\.\.?(/|\z)"), folded).otherwise(path)


def with_form(rows: DataFrame, into: str, prefix: str = "") -> DataFrame:
    """Adds what urls of the same page have in common, from their parts; null
    without a host."""
    host, path, query = (F.col(f"{prefix}{n}") for n in ("host", "path", "query"))
    telling = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    rows = rows.withColumns({"_telling": telling, "_plain": undotted(path)})
    form = F.concat(host, F.regexp_replace("_plain", r"/\z", ""), F.when(F.col("_telling") != "", F.concat(F.lit("?"), F.col("_telling"))).otherwise(""))
    return rows.withColumn(into, F.when(host != "", form)).drop("_telling", "_plain")


def resolved(target: Column, url: Column, prefix: str = "") -> Column:
    """An absolute url for a link's target on the page `url`, whose parts are
    columns; null where there is none."""
    scheme, host, path = (F.col(f"{prefix}{n}") for n in ("scheme", "host", "path"))
    root = F.concat(scheme, F.lit("://"), host)
    return (
        F.when((target == "") | target.startswith("#") | url.isNull(), F.lit(None))
        .when(target.rlike(SCHEME), F.when(target.rlike(SCHEME + "//"), target))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path, target))
        .otherwise(F.concat(root, F.regexp_extract(path, r"(?s)^(.*)/", 1), F.lit("/"), target))
    )


def match(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null where none does."""
    rule = action = F.lit(None).cast("string")
    for h, p, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def _value(tag: Column, attribute: str) -> Column:
    """An attribute's value, without its quotes; empty where it is missing."""
    bare = F.regexp_replace(F.regexp_extract(tag, attribute, 1), r"""^["']|["']\z""", "")
    return F.trim(F.regexp_replace(bare, AMPERSAND, "&"))


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between forms, from all canonical links and refreshes. The
    links are stored before they are resolved: they are few beside the pages."""
    html = F.coalesce("html", F.lit(""))
    bare = F.when(html.contains("<!--"), F.regexp_replace(html, COMMENT, "")).otherwise(html)
    found = pages.select("url", bare.alias("html")).filter(F.col("html").rlike(CANONICAL) | F.col("html").rlike(REFRESH))
    tags = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    links = F.transform(tags(CANONICAL), lambda tag: _value(tag, HREF))
    refreshes = F.transform(tags(REFRESH), lambda tag: F.trim(F.regexp_extract(_value(tag, CONTENT), TARGET, 1)))
    found = found.select("url", _value(F.regexp_extract("html", BASE, 0), HREF).alias("href"), F.explode(F.concat(links, refreshes)).alias("target"))
    # stored between steps: a filter would otherwise be pushed through all of them
    # and carry copies of their expressions along
    found = durable(with_form(with_parts(durable(found), "url"), "a"))
    found = found.select("a", "target", F.coalesce(resolved(F.col("href"), F.col("url")), "url").alias("base"))
    found = with_parts(durable(found), "base").select("a", resolved(F.col("target"), F.col("base")).alias("to"))
    return durable(with_form(with_parts(durable(found), "to"), "b").select("a", "b")).filter("a <> b").distinct()


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict. redirects: urls (src, dst)."""
    rule, action = match(F.col("host"), F.col("path"), rules)
    slim = with_form(with_parts(pages.select("page_id", "url"), "url"), "form").select("page_id", "host", "path", "form")
    slim = durable(slim.select("*", rule.alias("rule"), action.alias("action")))
    edges = link_edges(pages)
    if redirects is not None:
        ends = with_parts(with_form(with_parts(redirects.select("src", "dst"), "src"), "a"), "dst")
        edges = edges.unionByName(with_form(ends, "b").select("a", "b"))
    classes = connected_components(edges).select(F.col("node").alias("form"), "component")
    named = durable(lookup(slim, classes, "form").withColumn("class", F.coalesce("component", "form")))
    blocked = named.filter("action = 'block' and class is not null").select("class").distinct().withColumn("blocked", F.lit(True))
    found = lookup(named, durable(blocked), "class")
    verdict = F.coalesce("action", F.when(F.col("blocked"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
