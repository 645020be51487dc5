"""What recurs on a large host goes by the number of its pages, whatever share of the host they are."""

from scrubline.llm import html_templates


def texts(spark, pages: list[str]) -> list[str]:
    rows = [(i, f"http://a.example/{i}", page) for i, page in enumerate(pages)]
    df = html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    return [r.text for r in df.orderBy("page_id").collect()]


def test_rare_block_of_a_large_host(spark):
    """On 20 of 1,000 pages, 2 %, a block is template; on 10 it is not, and on 10 of 60 pages it is."""
    def page(i, n):
        notice = "<div><b>Members read this first</b></div>" if i < 20 else "<div><b>Rare remark</b></div>" if i < 30 else ""
        return f"<div><p>Story number {i} of {n}</p></div>{notice}"
    got = texts(spark, [page(i, 1000) for i in range(1000)])
    assert got == [f"Story number {i} of 1000" + ("\n\nRare remark" if 20 <= i < 30 else "") for i in range(1000)]
    assert texts(spark, [page(i, 60) for i in range(60)]) == [f"Story number {i} of 60" for i in range(60)]


def test_notice_in_every_article(spark):
    """A paragraph after the first, an item at the end: at one place of 40 articles they go, at places of their own they stay."""
    def page(i):
        middle = "".join(f"<p>Text {i} {j}</p>" for j in range(1, i % 5 + 2))
        said = [f"<p>Said {i} {j}</p>" for j in range(40)]
        said.insert(i, "<p>As they say.</p>")
        return (f"<article><h1>Title {i}</h1><p>Text {i} 0</p><p>Take out a <b>subscription</b> now.</p>{middle}{''.join(said)}"
                f"<ul><li>Own item {i}</li><li>All rights reserved</li></ul></article>")
    for i, text in enumerate(texts(spark, [page(i) for i in range(40)])):
        assert text.startswith(f"Title {i}\n\nText {i} 0\n\nText {i} 1") and text.endswith(f"Own item {i}")
        assert "subscription" not in text and text.count("As they say.") == 1 and f"Said {i} 39" in text


def test_few_articles_keep_their_notice(spark):
    pages = [f"<article><p>Text {i}</p><p>Take out a subscription now.</p></article>" for i in range(31)]
    assert all(text.endswith("subscription now.") for text in texts(spark, pages))
