"""HTML parser, card and overview extraction semantics."""

import pytest

from scorekit.plans import extraction as X
from scorekit.sources import html as H

CARD = ('<div class="companyCardWrapper x"><h2> Acme &amp; Co </h2><div class="rating_text">'
        '<span>4.2</span></div><span class="companyCardWrapper__companyRatingCount">(3.1k)</span>'
        '<meta itemprop="url" content="https://e.example/acme"></div>'
        '<div class="companyCardWrapper"></div>')


def test_card_fields():
    assert X.card_fields(CARD) == [
        (0, "Acme & Co", "4.2", "3.1k", "https://e.example/acme"),
        (1, None, None, None, None)]


def test_detail_label_value_variants():
    nxt = ('<div><div>Founded</div><div>Est. 1999</div></div>'
           '<div><div>Headquarters</div><div> Pune, India </div></div>'
           '<div><div>Employee Count</div><div>501-1k</div></div>')
    assert X.detail_fields(nxt) == ("1999", "Pune, India", "501-1k")
    prev = ('<div><div>since 2004</div><div>Founded in</div><div></div></div>'
            '<div><div>Headquarters</div><span>map</span></div><p><a href="#"> Delhi </a></p>'
            '<div><div>1 lakh+</div><div>Company Size</div></div>')
    assert X.detail_fields(prev) == ("2004", "Delhi", "1 lakh+")
    assert X.detail_fields("<p>nothing</p>") == (None, None, None)
    assert X.detail_fields("<div><div>Founded</div><div>n/a</div></div>")[0] is None


def test_string_through_single_child_chain():
    root = H.parse("<div><span><b>Founded</b></span></div><div>Founded</div>")
    first = H.find(root, tag="div", string=lambda s: "Founded" in s)
    assert first is root.children[0]


def test_script_text_and_unclosed_tags():
    root = H.parse('<body><script>var t="</p>";</script><p><b>a<br><p>b</div><h1>T &amp; U</h1>')
    assert H.find(root, tag="h1").text() == "T & U"
    assert H.find(root, tag="body").text().startswith("ab")


def test_page_queries_on_real_pages(spark):
    from scorekit.sources.tables import read_table
    pages = read_table(spark, "/root/testdata/sf0.001", "pages")
    heads = X.page_headings(pages).collect()
    assert all(h.heading for h in heads)
    lc = X.link_counts(pages).first()
    assert lc.total_links >= lc.unique_links > 0
    ads = X.extract_class_text(pages).collect()
    assert len(ads) == pages.count()


def test_class_text_any_class(spark):
    pages = spark.createDataFrame(
        [(1, '<div class="rating_text a">4.1</div><p class="x rating_text">3.9</p>'),
         (2, "<p>none</p>")], "page_id long, html string")
    out = X.extract_class_text(pages, "rating_text", "txt").orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.txt) for r in out] == [(1, 0, "4.1"), (1, 1, "3.9")]


def test_deeply_nested_page():
    root = H.parse("<div>" * 5000 + "x" + "<p>" * 5000 + '<h1 class="t">end</h1>')
    assert root.text() == "xend" and H.find(root, class_="t").string == "end"
    assert H.find(root, tag="div").string is None


def test_implied_end_tags_make_siblings():
    root = H.parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>one<p>two<div>three</div>"
                   "<table><tr><td>1<td>2<tr><td>3</table>")
    top = [n for n in root.children if n.tag == "ul"][0]
    assert [c.text() for c in top.children] == ["a", "bc", "d"]
    assert [p.text() for p in H.find_all(root, tag="p")] == ["one", "two"]
    assert [[d.text() for d in r.children] for r in H.find_all(root, tag="tr")] == [["1", "2"], ["3"]]


def test_links_in_any_quotes_and_case(spark):
    page = """<a href='x'>1</a><A HREF="y&amp;z">2</A><a class=k href=w>3</a>
              <a data-href="no">4</a><a title="a > b" href = "v&#x41;&#66;&nbsp;">5</a><abbr href="q">"""
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [r.href for r in X.page_links(pages).collect()] == ["x", "y&z", "w", "vAB\u00a0"]
    heads = spark.createDataFrame([(1, "<H1 id=a>T &amp;lt; &#8364;&hellip;</H1 >")],
                                  "page_id long, html string")
    assert X.page_headings(heads).first().heading == "T &lt; \u20ac\u2026"


def headings_and_links(spark, html):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    return X.page_headings(pages).first().heading, [r.href for r in X.page_links(pages).collect()]


@pytest.mark.parametrize("ref, text", [
    ("&#9999999;", "�"), ("&#xD800;", "�"), ("&#57343;", "�"), ("&#0;", "�"),
    ("&#x110000;", "�"), ("&#x10FFFF;", "\U0010ffff"), ("&#99999999999999999999;", "�"),
    ("&#xffffffffffffffffffff;", "�"), ("&#0000000065;", "A"), ("&#X00000041;", "A"),
    ("&#128512;", "\U0001f600"), ("&#;&#x;&#12", "&#;&#x;&#12"), ("&#55357;&#56832;", "�" * 2)])
def test_numeric_references(spark, ref, text):
    heading, links = headings_and_links(spark, f"<h1>a{ref}b</h1><a href='{ref}'>x</a>")
    assert heading == f"a{text}b" and links == [text]


def test_comments_scripts_and_styles_hold_no_elements(spark):
    heading, links = headings_and_links(spark, """<!-- <a href="com"> <h1>no</h1> -->
        <script type=x>var a = '<a href="js">'; <!-- </script><a href=1><style><a href=css></STYLE >
        <a href=2><h1>T<!-- c --> <a href=3>U</a></h1><!--><a href=4>--><a href=5><!-- open <a href=6>""")
    assert heading == "T U" and links == ["1", "2", "3", "4", "5"]
    assert headings_and_links(spark, "<script>no end <h1>x</h1><a href=1>") == (None, [])


def test_attributes_after_a_slash(spark):
    _, links = headings_and_links(spark, "<a/href=k><A HREF=y/><a class='c'/href='z'><a /href = w>")
    assert links == ["k", "y/", "z", "w"]
