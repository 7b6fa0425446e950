"""Blocks of a page: all its text, cut at its elements."""

import html as H
import re

from docgrain.plans import registry


def squeezed(text):
    return re.sub(r"\s+", "", H.unescape(re.sub("<[^>]+>", " ", text)))


def test_blocks_cover_the_whole_page(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in registry.table(spark, sf, "pages").collect()}
    got = {r.page_id: r.blocks for r in registry.page_blocks(spark, sf).collect()}
    assert set(got) == set(pages)
    for page, text in pages.items():
        shown = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", " ", text)
        assert "".join(squeezed(b.html) for b in got[page]) == squeezed(shown)
        kinds = {b.block_type for b in got[page]}
        assert {"SectionHeader", "ListGroup", "Text", "PageFooter"} <= kinds


def test_elements_of_odd_pages(spark):
    rows = [
        ("<p>a<p>b</p>c<script>x</p>y", ["<p>a", "<p>b</p>", "c "]),
        ("plain", ["plain"]),
        ("<title>t</title><div> </div><DIV class='x'>d<h1>h</h1>e</DIV>", ["<title>t</title>", "<DIV class='x'>d", "<h1>h</h1>", "e</DIV>"]),
        ("", []),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(rows)], "i int, h string")
    got = df.select("i", registry.page_elements(df.h).alias("e")).orderBy("i").collect()
    assert [r.e for r in got] == [e for _, e in rows]
