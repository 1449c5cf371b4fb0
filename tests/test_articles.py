"""Articles from pages without a join of the pages with themselves."""

from retrospect.operators import articles as a


def test_pages_are_read_once(spark):
    rows = [
        (1, "chicago", "https://a.org/lkl200102", "<h1>One</h1><div class='cfedContent__text'><p>Text.</p></div>"),
        (2, "chicago", "https://a.org/lkl200103", "words only"),
        (3, "chicago", None, None),
        (4, "nowhere", "https://a.org/lkl200104", "<h1>Four</h1>"),
        (5, "chicago", "https://a.org/x", "<h1>Five</h1>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, site string, url string, html string")
    found = a.articles(pages)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    read = {r.page_id: r for r in found.collect()}
    assert sorted(read) == [1, 2, 3, 4, 5]
    assert (read[1].title, str(read[1].published), read[1].paragraphs, read[1].missing) == ("One", "2020-01-02", ["Text."], [])
    assert (read[2].title, str(read[2].published), read[2].paragraphs, read[2].missing) == (None, "2020-01-03", None, ["title", "body"])
    assert read[3].url is None and read[3].missing == ["date", "title", "body"]
    assert read[4].title is None and "speaker" in read[4].missing
    assert read[5].paragraphs == [] and read[5].missing == ["date", "body"]


def test_ingest_keeps_the_site(spark):
    pages = spark.createDataFrame([(1, "boston", "https://a.org/lkl200102", "<a class='byline-link'>Ann Lee</a>")], "page_id long, site string, url string, html string")
    people = spark.createDataFrame([(7, "Ann Lee")], "id long, name string")
    rows = a.ingested(a.articles(pages), people).collect()
    assert [(r.page_id, r.site, r.participant, r.status) for r in rows] == [(1, "boston", 7, "INCOMPLETE")]
