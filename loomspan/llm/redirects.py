"""URL verdicts by rules, carried along redirects and canonical links.

An address is a url's host, path and query: the scheme and the fragment name no other page. A
rule (host, path, verdict) fits an address on its host or a subdomain whose path starts with
the rule's; the longest wins, and of equal ones that allows. Redirects (refresh tags) and
canonical links of the pages are edges between addresses, on which connected components are
found by alternating stars: the members of a component are aliases. A rule's verdict holds for
its own address, and so an explicit allow goes before anything an alias brings. Among the other
addresses those are blocked that have a blocked alias, whether it is a page of the table or
only linked to; the rest are allowed.

Defined cases: a url that is null or has no ``://`` has empty host and path, and no rule; such
a page stands at the least address that its own links name, if any. Links within comments,
scripts and styles don't count, nor do empty ones and those of schemes without ``//``; relative
links are resolved against the page's url, dot segments staying as they are. Null html has no
links. Repeated rows and ids are rows of their own; other columns, of whatever names, are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.components import components
from loomspan.llm.shared import table

#: The rules of the registered query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Rows of a side that may be broadcast.
SMALL = 100_000

UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAGS = r"(?i)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?i)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
REFRESH = r"(?i)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
#: An attribute's value, quoted in either way or bare.
VALUE = r"(?i)\b{0}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
REFRESH_URL = r"(?i)\burl\s*=\s*['\"]?([^'\"]*)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or nothing."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """Host, path and query; null without a host."""
    return F.nullif(F.concat(host_of(url), F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)), F.lit(""))


def links_of(html: Column) -> Column:
    """What refresh tags and canonical links of a page name, as written."""
    attribute = lambda tag, name: F.concat(*[F.regexp_extract(tag, VALUE.format(name), g) for g in (1, 2, 3)])
    tags = F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " "), F.lit(TAGS), 0)
    tags = F.transform(tags, lambda t: F.regexp_replace(t, r"\s+", " "))
    named = F.transform(tags, lambda t: F.when(t.rlike(CANONICAL), attribute(t, "href")).when(t.rlike(REFRESH), F.regexp_extract(attribute(t, "content"), REFRESH_URL, 1)).otherwise(F.lit("")))
    named = F.transform(named, lambda x: F.trim(F.replace(x, F.lit("&amp;"), F.lit("&"))))
    return F.filter(named, lambda x: x != "")


def resolved(link: Column, host: Column, path: Column) -> Column:
    """The address that a link of a page at ``host`` and ``path`` names; null if none."""
    base = F.concat(F.lit("x://"), host)
    url = (
        F.when(link.rlike(SCHEME + "//"), link)
        .when(link.rlike(SCHEME), F.lit(None))
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(host == "", F.lit(None))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.rlike("^[?#]"), F.concat(base, path, link))
        .otherwise(F.concat(base, F.when(path == "", "/").otherwise(F.regexp_extract(path, "^.*/", 0)), link))
    )
    return address_of(url)


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def ruled(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(address, rule, verdict) of the addresses that a rule (host, path, verdict) fits."""
    labels = F.split(F.regexp_extract("address", "^[^/?]*", 0), r"\.")
    within = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = addresses.select("address", F.regexp_extract("address", "^[^/?]*([^?]*)", 1).alias("at"), F.explode(within).alias("domain"))
    rules = rules.select(F.col("host").alias("domain"), F.col("path").alias("start"), (F.col("verdict") == "allow").alias("allows"))
    hits = probes.join(_small(rules), "domain").where(F.startswith("at", "start"))
    name = F.concat("domain", "start")
    best = hits.groupBy("address").agg(F.max(F.struct(F.char_length(name).alias("n"), "allows", name.alias("rule"))).alias("b"))
    return best.select("address", "b.rule", F.when(F.col("b.allows"), "allow").otherwise("block").alias("verdict"))


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, via, component) of every page.

    ``via`` tells what decided: rule, alias or neither (none). ``edges`` (source, target) of
    urls may add redirects that a crawl has met.
    """
    url, host, path = F.col(url_col), host_of(F.col(url_col)), path_of(F.col(url_col))
    plain = lambda c: F.coalesce(c, F.lit(""))
    seen = pages.select(F.col(id_col).alias("id"), plain(host).alias("host"), plain(path).alias("path"), address_of(url).alias("own"), links_of(F.col(html_col)).alias("links"))
    names = F.array_distinct(F.filter(F.transform("links", lambda x: resolved(x, F.col("host"), F.col("path"))), lambda x: x.isNotNull()))
    seen = seen.select("id", "host", "path", "own", names.alias("names"))
    seen = table(seen.select("id", "host", "path", F.coalesce("own", F.array_min("names")).alias("address"), F.col("own").isNotNull().alias("placed"), "names"), "addresses")
    links = seen.select(F.col("address").alias("a"), F.explode("names").alias("b"))
    if edges is not None:
        links = links.unionByName(edges.select(address_of(F.col("source")).alias("a"), address_of(F.col("target")).alias("b")).where("a is not null and b is not null"))
    links = table(links.distinct(), "alias-links")
    every = seen.select("address").where("address is not null").union(links.select("a")).union(links.select("b")).distinct()
    verdicts = table(ruled(every, rules), "verdicts")
    members = table(components(links), "aliases").withColumnRenamed("id", "address")
    bad = members.join(verdicts.where("verdict = 'block'").select("address"), "address", "left_semi").select("component_id").distinct()
    aliases = members.join(_small(bad.withColumn("blocked", F.lit(True))), "component_id", "left")
    known = verdicts.join(aliases, "address", "full")
    out = seen.join(known, "address", "left")
    own = F.col("placed") & F.col("rule").isNotNull()
    # a page without url has no rule of its own: its address's rule reaches it as an alias
    blocked = F.coalesce("blocked", F.lit(False)) | F.coalesce(F.col("verdict") == "block", F.lit(False))
    return out.select(
        "id", "host", "path",
        F.when(own, F.col("rule")).alias("rule"),
        F.when(own, F.col("verdict")).when(blocked, "block").otherwise("allow").alias("verdict"),
        F.when(own, "rule").when(blocked, "alias").otherwise("none").alias("via"),
        F.coalesce("component_id", "address").alias("component"),
    )


def op13_redirect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url of ``pages``."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "via", "component")
