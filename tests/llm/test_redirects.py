"""URL verdicts: rules, links and aliases against plain Python and SQL."""

import duckdb

from loomspan.llm import redirects as D
from loomspan.llm.queries import oracle_sql

SCHEMA = "page_id long, url string, html string, host int, verdict string, address string, names string"


def canonical(href):
    return f"<head><LINK rel='canonical' href=\"{href}\"></head>"


def moved(url):
    return f'<meta http-equiv="Refresh" content="0; URL={url}">'


PAGES = [
    (1, "http://a.example.org/es/1", None),  # blocked by rule
    (2, "https://x.net/one", canonical("http://a.example.org/es/1")),  # alias of 1
    (3, "https://x.net/two#part", moved("/one?")),  # /one? is another address
    (4, "https://x.net/three", moved("one")),  # relative, to 2
    (5, "https://b.org/free", canonical("https://x.net/three")),  # allowed by rule, and links the chain on
    (6, "https://y.net/after", canonical("https://b.org/free")),  # reached through an allowed address
    (7, "https://z.net/", canonical("https://shop.com/de/9")),  # blocked address that is no page
    (8, "https://z.net/a", "<!-- " + canonical("https://shop.com/de/9") + " --><script>var x='" + canonical("https://shop.com/de/9") + "'</script>"),
    (9, None, canonical("https://shop.com/de/9")),  # stands where its link says
    (10, "no scheme", canonical("//shop.com/de/9")),
    (11, None, None),
    (12, "HTTP://SHOP.COM/fr/A?x=/de/#y", None),
    (13, "http://example.org/es", None),  # the path lacks the rule's last stroke: org/ fits
    (14, "http://example.org?x", None),  # an empty path fits nothing
    (15, "http://notexample.org/es/", None),
    (16, "http://example.org/en/12", None),
    (17, "http://w.net/dir/page", '<link href=other rel="x canonical">'),
    (18, "https://w.net/dir/other", moved("mailto:me@shop.com")),
    (19, "http://q.net/1", canonical("?a=1&amp;b=2")),
    (20, "http://q.net/1?a=1&b=2", moved("https://shop.com/de/")),
    (21, "http://É.EXAMPLE.ORG:80/es/", None),
    (22, "https://x.net/one", None),  # the same address again
    (22, "https://x.net/one", None),
    (23, "x://", ""),
]


def brute(pages):
    """Verdicts by a union of sets; links are given, not parsed."""
    split = lambda u: (u.split("://", 1)[1].split("#")[0] if u and "://" in u else "")
    host = lambda u: "".join(c.lower() if "A" <= c <= "Z" else c for c in split(u).split("?")[0].split("/")[0])
    path = lambda u: split(u).split("?")[0][len(host(u)) :]
    address = lambda u: (host(u) + split(u)[len(host(u)) :]) or None
    links = {2: "http://a.example.org/es/1", 3: "x://x.net/one?", 4: "x://x.net/one", 5: "x://x.net/three", 6: "x://b.org/free", 7: "x://shop.com/de/9", 9: "x://shop.com/de/9", 10: "x://shop.com/de/9", 17: "x://w.net/dir/other", 19: "x://q.net/1?a=1&b=2", 20: "x://shop.com/de/"}

    def rule(h, p):
        fit = [(len(rh + rp), v == "allow", rh + rp, v) for rh, rp, v in D.RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        return max(fit)[2:] if fit else None

    of = {}
    for i, u, _ in pages:
        for a in {address(u), address(links.get(i))} - {None}:
            of.setdefault(a, {a})
    for i, u, _ in pages:
        if i in links and address(u):
            both = of[address(u)] | of[address(links[i])]
            for a in both:
                of[a] = both
    ruled = lambda a: rule(a.split("?")[0].split("/")[0], a.split("?")[0][len(a.split("?")[0].split("/")[0]) :])
    out = []
    for i, u, _ in pages:
        own, at = rule(host(u), path(u)) if address(u) else None, address(u) or address(links.get(i))
        bad = at is not None and any((ruled(a) or ("", ""))[1] == "block" for a in of[at])
        out.append((i, host(u), path(u), own and own[0], own[1] if own else "block" if bad else "allow"))
    return sorted(out, key=str)


def test_verdicts_equal_brute_force_and_sql(spark, tmp_path):
    rows = [(i, u, h, 1, "block", "x", "y") for i, u, h in PAGES]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    out = D.op13_redirect_classes(spark, str(tmp_path))
    got = out.collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == brute(PAGES)
    via = {r.page_id: r.via for r in got}
    assert [via[i] for i in (1, 2, 5, 6, 8, 9, 11, 16, 20)] == ["rule", "alias", "rule", "alias", "none", "alias", "none", "rule", "alias"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict", "via", "component"]
    unique = [r for r in con.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()['op13_redirect_classes']})").fetchall()]
    assert {tuple(r[c] for c in cols) for r in got} == set(unique)


def test_rules_of_equal_length_allow_and_edges_of_a_crawl_count(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", None), (2, "http://b.net/", None), (3, "http://c.net/", None)], "page_id long, url string, html string")
    rules = spark.createDataFrame([("a.net", "/x", "block"), ("a.net", "/x", "allow"), ("c.net", "/", "block")], "host string, path string, verdict string")
    crawl = spark.createDataFrame([("http://b.net/", "http://c.net/"), ("nothing", "http://c.net/"), (None, None)], "source string, target string")
    out = {r.id: (r.verdict, r.via) for r in D.judged(pages, rules, edges=crawl).collect()}
    assert out == {1: ("allow", "rule"), 2: ("block", "alias"), 3: ("block", "rule")}


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert D.op13_redirect_classes(spark, str(tmp_path)).collect() == []
