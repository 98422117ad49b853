"""Feed pages with namespaces, what entries may lack, and the archive's pruning."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomspan.sources import feeds

HEAD = f'<?xml version="1.0" encoding="UTF-8"?>\n<feed {feeds.NAMESPACES}>'
ENTRY = """<entry><id>http://feed.example/abs/2401.0000{n}v{v}</id><title>A
  title {n}</title><summary> An abstract. </summary><published>2024-0{n}-05T10:00:00Z</published>{more}</entry>"""


def page(*entries, total="<opensearch:totalResults>57</opensearch:totalResults>"):
    return HEAD + total + "".join(entries) + "</feed>"


def parsed(spark, *pages):
    return {r.paper_id: r for r in feeds.entries(spark.createDataFrame([(p,) for p in pages], "value string")).collect()}


def test_a_namespaced_page_gives_category_total_links_and_authors(spark):
    more = '<feed:primary_category term="cs.LG"/><category term="cs.IR"/><category term=""/><category term="cs.LG"/><author><name>Ada  L</name></author><author><name/></author>' + (
        '<link rel="alternate" href="http://x/1"/><link title="pdf" rel="related" href="http://x/1.pdf"/><link rel="alternate" href="http://x/2"/><updated>2024-02-01T00:00:00Z</updated>'
    )
    row = parsed(spark, page(ENTRY.format(n=1, v=3, more=more)))["2401.00001"]
    assert (row.version, row.title, row.abstract, row.total) == (3, "A title 1", "An abstract.", 57)
    assert (row.primary_category, row.categories, row.authors) == ("cs.LG", ["cs.IR", "cs.LG"], ["Ada L"])
    assert (row.abs_url, row.pdf_url) == ("http://x/2", "http://x/1.pdf")
    assert row.updated > row.published


def test_what_an_entry_lacks_is_filled_in_or_makes_it_go(spark):
    entries = [
        ENTRY.format(n=1, v=2, more='<category term="hep-ex"/>'),
        ENTRY.format(n=2, v=1, more="").replace("<summary> An abstract. </summary>", ""),
        ENTRY.format(n=3, v=1, more="").replace("2024-03-05T10:00:00Z", "some day"),
        ENTRY.format(n=4, v=1, more="").replace("http://feed.example/abs/2401.00004v1", " "),
    ]
    rows = parsed(spark, page(*entries, total="<opensearch:totalResults>many</opensearch:totalResults>"))
    assert set(rows) == {"2401.00001"}
    row = rows["2401.00001"]
    assert (row.primary_category, row.total, row.updated) == ("hep-ex", 0, row.published)
    assert (row.abs_url, row.pdf_url) == ("https://feed.example/abs/2401.00001v2", "https://feed.example/pdf/2401.00001v2")


def test_pages_without_entries_or_namespaces_are_read_and_broken_ones_are_errors(spark):
    assert parsed(spark, page(), "<feed><totalResults>0</totalResults></feed>") == {}
    assert parsed(spark, f"<feed>{ENTRY.format(n=1, v=1, more='')}</feed>")["2401.00001"].total == 0
    for bad in ("<feed><entry>truncated", "no page", page(ENTRY.format(n=1, v=1, more="")).removesuffix("</feed>")):
        with pytest.raises(Exception, match="(?i)malformed|parse|invalid"):
            parsed(spark, bad)


def test_a_window_reads_its_months_only(spark, tmp_path):
    pages = spark.createDataFrame([(page(*[ENTRY.format(n=n, v=1, more="") for n in range(1, 10)]),)], "value string")
    feeds.archived(feeds.entries(pages), str(tmp_path))
    found = feeds.published_within(spark, str(tmp_path), datetime(2024, 3, 5, 10), datetime(2024, 5, 5, 9, 59))
    assert sorted(r.paper_id for r in found.collect()) == ["2401.00003", "2401.00004"]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    files = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("month=")[1][:7] for r in files} == {"2024-03", "2024-04"}
    assert "PushedFilters: [IsNotNull(published), GreaterThanOrEqual(published" in plan


def test_search_texts(spark):
    row = spark.sql("SELECT array('a', 'b') AS c, timestamp'2024-01-02 03:04:05' AS s, timestamp'2024-02-03 04:05:59' AS u, cast(null AS timestamp) AS n")
    text = row.select(feeds.search_text(F.col("c"), F.col("s"), F.col("u")), feeds.search_text(F.col("c"), F.col("n"), F.col("u"))).first()
    assert tuple(text) == ("(cat:a OR cat:b) AND submittedDate:[202401020304 TO 202402030405]", "(cat:a OR cat:b)")
