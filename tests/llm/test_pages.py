"""Main text of pages: templates decide, and odd input."""

import pytest

from prefixloom.llm import html_templates as ht
from prefixloom.llm import queries

SCHEMA = "page_id long, url string, html string"
# No article, no main, no telling names: only repetition over the host shows what is what.
SOUP = (
    "<html><body><div><div><a href=/1>{menu}</a> <a href=/2>{menu} two</a></div><div>Free delivery on all orders, and a long line on every page of this host.</div></div>"
    "<div><h1>Title {i}</h1><div><p>First part of page {i}, with {j} words.</p></div><div><p>Second part, other words {k}.</p><p>{more}</p></div></div><div>Copyright of the host.</div></body></html>"
)


def soup(i):
    return SOUP.format(i=i, j=i * 7, k=i * i, menu=f"go {i % 5}", more=f"Third part {i} " + "and more " * (i % 4 + 3))


def wanted(i):
    return " ".join(f"Title {i} First part of page {i}, with {i * 7} words. Second part, other words {i * i}. Third part {i} {'and more ' * (i % 4 + 3)}".split())


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(((r.page_id, r.text) for r in ht.extracted(df, **more).collect()), key=str)


@pytest.mark.parametrize("size", [2_000_000, 0])
def test_template_decides_without_article(spark, size):
    rows = [(i, "http://soup.example/x", soup(i)) for i in range(20)]
    assert got(spark, rows, broadcast_tokens=size) == sorted(((i, wanted(i)) for i in range(20)), key=str)
    # Without the host's other pages the repeated lines can't be told from the text.
    assert ht.main_text(soup(3)) != wanted(3) and "Free delivery" in ht.main_text(soup(3))


def test_repeated_rows_and_null_ids_are_pages(spark):
    rows = [(None if i % 2 else i, "http://soup.example/x", soup(i)) for i in range(10)] * 2
    assert got(spark, rows) == sorted([(None if i % 2 else i, wanted(i)) for i in range(10)] * 2, key=str)


def test_classes_nest():
    rows, at = [], 0
    for token, parent, vector, bits in [(1, 0, 7, ht.IS_LAYOUT), (2, 1, 7, ht.IS_LAYOUT), (3, 2, 9, 0), (4, 3, 9, 0), (5, 1, 7, 0), (6, 5, 11, 0)]:
        rows.append({"token": token, "parent": parent, "vector": vector, "bits": bits, "place": at, "pages": 10 if vector == 7 else 9, "chars": 10, "linked": 0})
        at += 1
    classes, slots = ht.nested(rows, 10)
    assert classes == [[1, 2, 5], [3, 4]]  # a class of one token that isn't on every page is no template
    assert slots == {1: (0, 1)}  # opened by token 2


def test_equal_tags_in_different_roles_are_told_apart():
    page = ht.Page("<body><div>a</div><div>b</div><div>c</div>" + "<p>x</p>" * 9)
    assert len(set(page.tokens)) == 1 + 3 + 1


def test_names_inside_articles():
    inside = '<article><p>One.</p><div class="data-share-table"><p>Two of the article.</p></div><div class="share"><p>Tell your friends</p></div></article>'
    assert ht.main_text(inside) == "One. Two of the article."
    # Part of a name counts if the container stands on the host's pages.
    token = ht.Page('<article><p>One.</p><div class="top-ads"><p>Buy</p></div></article>')
    assert ht.main_text('<article><p>One.</p><div class="top-ads"><p>Buy</p></div></article>') == "One. Buy"
    roles = {t: ht.LEFT_OUT if "top-ads" in p and p.startswith("/article/div.") else ht.OPEN for t, p in zip(token.tokens, token.paths)}
    assert ht.main_text('<article><p>One.</p><div class="top-ads"><p>Buy</p></div></article>', roles | {token.tokens[0]: ht.MAIN_SLOT}) == "One."


def test_contents_that_are_no_scripts():
    assert ht.main_text("<article><p>Let <math><mi>x</mi></math> be one.</p><xmp>code sample</xmp><object>kept</object><canvas>too</canvas></article>") == "Let x be one. code sample kepttoo"
    assert ht.main_text("<article>H<svg><text>no</text></svg>O and w<wbr>ord<script>x</script>s</article>") == "HO and words"


def test_article_that_repeats_over_a_host(spark):
    page = "<html><body><nav>m {i}</nav><article><h1>Same</h1><p>The same article everywhere.</p></article></body></html>"
    rows = [(i, "http://h/", page.replace("{i}", str(i))) for i in range(8)]
    assert {t for _, t in got(spark, rows)} == {"Same The same article everywhere."}


def test_edited_copies_of_an_article(spark):
    """Most paragraphs are on every page, yet they are the article; a short line among articles of their own is a notice."""
    paragraphs = [f"Paragraph {k} of an article that is copied all over the host." for k in range(9)]
    page = "<html><body><nav>m {i}</nav><article><h1>Copy</h1>{p}</article></body></html>"
    rows, want = [], []
    for i in range(10):
        own = [*paragraphs[: i % 9], f"Edited paragraph {i}.", *paragraphs[i % 9 + 1 :]] if i else paragraphs
        rows.append((i, "http://copies/", page.format(i=i, p="".join(f"<p>{x}</p>" for x in own))))
        want.append((i, " ".join(["Copy", *own])))
    for i in range(10):
        rows.append((100 + i, "http://notices/", page.format(i=i, p=f"<p>An article of its own, number {i}, with {i * 7} words and more words.</p><p>Sign up.</p>")))
        want.append((100 + i, f"Copy An article of its own, number {i}, with {i * 7} words and more words."))
    assert got(spark, rows) == sorted(want, key=str)


def test_odd_tables(spark):
    assert got(spark, []) == []
    long = "<html><body><article>" + "<p>word &amp; word</p>" * 60_000 + "</article></body></html>"
    assert got(spark, [(1, None, long), (2, "http://a/", None), (None, "", "")]) == sorted([(1, " ".join(["word & word"] * 60_000)), (2, ""), (None, "")], key=str)
    df = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "clash", 5, "kept")], SCHEMA + ", TEXT string, n_chars int, host string")
    out = ht.extracted(df)
    assert sorted(out.columns) == ["host", "n_chars", "page_id", "text", "url"] and [tuple(r) for r in out.select("text", "n_chars", "host").collect()] == [("x", 1, "kept")]


def test_hot_host_and_small_hosts(spark):
    rows = [(i, "http://soup.example/x", soup(i)) for i in range(300)] + [(1000 + i, f"http://s{i}/", f"<body><p>own {i}</p>") for i in range(30)]
    assert got(spark, rows) == sorted([(i, wanted(i)) for i in range(300)] + [(1000 + i, f"own {i}") for i in range(30)], key=str)


def test_query_equals_a_plain_reading_of_the_article(spark):
    import html
    import re

    sf = "/root/testdata/sf0.01"
    out = {r.page_id: r for r in queries.op5_main_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(out) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", p.html, re.S)[1]
        plain = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:b|a)\b[^>]*>", "", body))).split())
        assert (out[p.page_id].text, out[p.page_id].n_chars, out[p.page_id].url) == (plain, len(plain), p.url)
