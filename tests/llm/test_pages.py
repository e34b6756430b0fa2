"""HTML extraction and URL templates on whole small tables: odd rows, merging, rejection, and the SQL of the URL filter."""

import random

import duckdb
import pyarrow as pa
import pytest

from oxbow.llm import html, urls

ARTICLE = "<html><body><nav><ul><li><a href=/a>Menu</a><li><a href=/b>More</a></ul></nav><article><h1>T &amp; x</h1><p>One&nbsp;two, <b>three\n four.</b><p>Is.<svg><text>a</text><p>The rest, still there.</p><math><mi>x</mi></math> <noscript>y</noscript></article><div id=comments><p>A comment, quite long and friendly, on it all.</p></div><footer>&copy; f</footer>"
TEXT = "T & x\n\nOne two, three four.\n\nIs.a\n\nThe rest, still there.\n\nx"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, text string").repartition(2)


def test_pages_of_all_kinds(spark):
    long = "<article>" + "<p>Some words, here they are.</p>" * 20_000 + "</article>"
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (3, "v", ""), (None, "w", "<article>No id here."), (4, "x", long), (5, "y", "<p " * 3000), (6, "z", "<article><p>Before.<script>if (a) {<p>After, unclosed script.</article>")]
    found = html.extract_pages(pages(spark, rows)).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    by = {r["page_id"]: r["text"] for r in found}
    assert by[1].startswith(TEXT) and "comment" not in by[1] and "Menu" not in by[1] and "©" not in by[1]
    assert sum(r["page_id"] == 1 for r in found) == 2
    assert (by[2], by[3], by[None]) == ("", "", "No id here.")
    assert by[4].count("Some words, here they are.") == 20_000
    assert by[6] == "Before.\n\nAfter, unclosed script."
    assert html.extract_pages(pages(spark, rows).limit(0)).collect() == []


def test_the_cut_decides():
    """Labels differ from the sign of the text's own score, inside an article and where nothing tells."""
    changed = 0
    for page in (ARTICLE, "<div><div><h2>Head</h2><div>Some long text without any telling element, that goes on and on for quite a while; it has commas, and more of them.</div><div>Short</div></div><div><a>one</a></div><div><a>two</a></div></div>"):
        blocks, places = html.blocks_of(page)
        costs, edges = html.graph_of(blocks, places, html.DEFAULT)
        changed += sum((c > 0) != k for c, k in zip(costs[: len(blocks)], html.cut(costs, edges), strict=False))
    assert changed >= 2
    assert html.main_text(page).endswith("Short") and "one" not in html.main_text(page)


def test_fitted_weights():
    """Heavy evidence moves the weights, none leaves them, and batches don't matter."""
    assert html.fit([]) == html.DEFAULT and html.fit([(3, 1, 0, 0, 1, 50)]) == html.DEFAULT
    weights = html.fit([(0, 0, 0, 4, 1, 5000), (0, 0, 0, 0, 0, 5000)])
    assert weights[4] > html.DEFAULT[4] + 3
    one = pa.RecordBatch.from_arrays([pa.array([ARTICLE, None, ARTICLE])], ["html"])
    counted = next(html.count_features(iter([one]))).to_pylist()
    assert sum(r["times"] for r in counted) == 2 * sum(b.label() >= 0 for b in html.blocks_of(ARTICLE)[0])


def judged(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in rows], "page_id int, url string, host string, purity int").repartition(2)
    return urls.judge_urls(df, **kwargs).collect()


def test_merging_and_rejection(spark):
    """Sibling branches alike in their labels become one template; a URL without a rule is rejected with it, another is not."""
    rules = (("block", "bad.org", "/x/promo"), ("block", "bad.org", "/y/promo"), ("allow", "bad.org", "/z/"))
    rows = [(n, f"http://bad.org/{'xy'[n % 2]}/promo{n}") for n in range(200)] + [(1000 + n, f"http://bad.org/z/{n}") for n in range(60)]
    rows += [(2000, "http://bad.org/x/7"), (2001, "http://bad.org/y/8"), (2002, "http://good.org/x/7")]
    found = {r["page_id"]: r for r in judged(spark, rows, rules=rules)}
    assert found[2000]["rule"] is None and found[2000]["verdict"] == "block" and found[2000]["template"] == ["{blocked}", "*"] == found[2001]["template"]
    assert found[2000]["purity"] == found[2001]["purity"] > 0.9
    assert found[2002]["verdict"] == "allow" and found[2002]["template"] == ["x", "*"] and found[2002]["purity"] != urls.PRIOR
    assert found[1000]["verdict"] == "allow"


def test_wide_parents_are_generalised(spark):
    rows = [(n, f"http://h.org/tag/{'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10]}/deep") for n in range(100)] + [(500, "http://h.org/other/deep")]
    found = {r["page_id"]: r["template"] for r in judged(spark, rows)}
    assert {tuple(found[n]) for n in range(100)} == {("tag", "*", "deep")} and found[500] == ["other", "deep"]


def test_urls_as_sql(spark):
    """The whole query against its SQL, with deep paths, long hosts, wide parents, nulls, repeats and ties."""
    r = random.Random(3)
    words = ["en", "de", "es", "fr", "7x", "8y", "news", "a.b", ""]
    hosts = ["a.example.com", "EXAMPLE.com", "net", "x.example.net", "b.org", ".".join("abcdefghijkl"), "", "com"]
    rows = [(i, f"http://{r.choice(hosts)}/" + "/".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 12]))) + r.choice(["", "?q=/en/", "#x"])) for i in range(400)]
    rows += [(400 + i, f"http://wide.net/{'de' if i % 3 else 'fr'}/{chr(97 + i % 26)}{chr(97 + i // 26)}/end") for i in range(200)]
    rows += [(700, None), (701, ""), (702, "no scheme"), (703, "x://"), (704, "://h//en//"), (705, "http://com/" + "s/" * 3000), (0, rows[0][1]), (None, "http://net/de/1")]
    con = duckdb.connect()
    pages = pa.table({"page_id": [i for i, _ in rows], "url": [u for _, u in rows]})  # noqa: F841
    want = con.sql(urls.as_sql()).fetchall()
    found = [(x["page_id"], x["host"], x["path"], x["rule"], x["verdict"], None if x["purity"] is None else round(x["purity"], 6)) for x in judged(spark, rows)]
    assert sorted(map(repr, found)) == sorted(repr((*x[:5], None if x[5] is None else round(x[5], 6))) for x in want)
    assert judged(spark, rows[:1])[0]["page_id"] == 0
    empty = spark.createDataFrame([], "page_id int, url string")
    assert urls.judge_urls(empty).collect() == []


@pytest.mark.parametrize("host, want", [("", [""]), ("a.b.c", ["c", "b.c", "a.b.c"])])
def test_suffixes(spark, host, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(urls.suffixes_of(F.lit(host)).alias("s")).first()["s"] == want
