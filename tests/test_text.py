from pyspark.sql import functions as F

from docgrain.functions import text as X


def one(spark, expr, ddl="a string", *values):
    return spark.createDataFrame([values or (None,)], ddl).select(expr.alias("x")).first().x


def test_strip_html(spark):
    a = F.col("a")
    cases = {
        "<p>a&nbsp;b</p>": "a b",
        "&amp;lt;": "<",
        " x \n\ty z\x1c ": "x y z",
        "&#39;q&#39; &quot;w&quot;": "'q' \"w\"",
        "<a\nhref='x'>t</a>": "t",
        "": "",
    }
    for raw, want in cases.items():
        assert one(spark, X.strip_html(a), "a string", raw) == want
    assert one(spark, X.strip_html(a), "a string", None) == ""


def test_block_texts(spark):
    ddl, a, b = "a string, b string", F.col("a"), F.col("b")
    assert one(spark, X.display_text(a, b), ddl, "<i> </i>", " md ") == " md "
    assert one(spark, X.display_text(a, b), ddl, "<i>h</i>", "md") == "h"
    assert one(spark, X.item_text(a, b), ddl, "<i>h</i>", " md ") == "md"
    assert one(spark, X.item_text(a, b), ddl, "<i>h</i>", "  ") == "h"
    assert one(spark, X.anchor_text(a, b), ddl, "", "m&amp;d") == "m&amp;d"
    assert one(spark, X.anchor_text(a, b), ddl, "<b>h</b>", "md") == " h "
    assert one(spark, X.anchor_text(a, b), ddl, None, None) == ""


def test_keys_and_labels(spark):
    a = F.col("a")
    assert one(spark, X.norm_key(a), "a string", "DO-61 581/Ä") == "do61581"
    assert one(spark, X.block_label(a), "a string", "Caption") == "caption"
    assert one(spark, X.block_label(a), "a string", "Stamp") == "text"
    assert one(spark, X.block_id_page(a), "a string", "/page/3/Text/1") == 4
    assert one(spark, X.block_id_page(a), "a string", "page/3") is None
    assert one(spark, X.page_or_none(a), "a int", None) == 0
    assert one(spark, X.page_or_first(a), "a int", None) == 1


def test_section_level(spark):
    h, ddl = F.col("a"), "a map<string,string>"
    assert one(spark, X.section_level(h), ddl, {"1": "x", "3": "y"}) == 3
    assert one(spark, X.section_level(h), ddl, {"9": "x"}) == 6
    assert one(spark, X.section_level(h), ddl, {"2": "x", "top": "y"}) == 1
    assert one(spark, X.section_level(h), ddl, {}) == 1
    assert one(spark, X.section_level(h), ddl, None) == 1
    assert one(spark, X.section_level(h), ddl, {"0": "x"}) == 0


def test_list_items(spark):
    html = "<UL><LI class='a'>one<br>two</LI><li>th\nree &amp; 4</li></UL>"
    assert one(spark, X.list_items(F.col("a")), "a string", html) == ["one two", "th ree & 4"]
    assert one(spark, X.list_items(F.col("a")), "a string", None) == []
