"""URL filter and line dedup."""

import pytest

from threadlens.llm import line_dedup, url_filter


def judged(spark, urls, listed=(), **options):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    lists = spark.createDataFrame([(u,) for u in listed], "url string")
    rows = url_filter.url_filter(pages, lists, **options).collect()
    return {urls[r["page_id"]]: r for r in rows}


def test_rules_and_parts(spark):
    urls = [
        "http://A.Example.NET/en/x?q#f", "https://example.net/de/", "ftp://x.example.com/de/1", "http://example.com/fr/",
        "http://w.org/fr/a", "http://w.org/en/", "http://net", "http://net/", "http://notnet/", "no scheme", "", None,
        "http://net:80/x", "x://y://z.net/a", "http://sub.a.net?x=/", "http://host.net#/a",
    ]
    got = judged(spark, urls)
    assert got["http://A.Example.NET/en/x?q#f"][1:5] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got["https://example.net/de/"][3:5] == ("net/", "block")
    assert got["ftp://x.example.com/de/1"][3:5] == ("example.com/de/", "block")
    assert got["http://example.com/fr/"][3:5] == (None, "allow")
    assert got["http://w.org/fr/a"][3:5] == ("org/fr/", "allow")
    assert got["http://net"][1:5] == ("net", "", None, "allow")
    assert got["http://net/"][3] == "net/"
    assert got["http://notnet/"][3] is None
    for u in ("no scheme", "", None):
        assert got[u][1:5] == ("", "", None, "allow")
    assert got["http://net:80/x"][1:4] == ("net:80", "/x", None)
    assert got["x://y://z.net/a"][1:3] == ("y:", "//z.net/a")
    assert got["http://sub.a.net?x=/"][1:4] == ("sub.a.net", "", None)
    assert got["http://host.net#/a"][1:4] == ("host.net", "", None)


@pytest.mark.parametrize("blocks", [1, 1 << 20])
def test_list_is_exact_at_any_filter_size(spark, blocks):
    """One block makes nearly every URL a possible hit; the join removes them."""
    listed = [f"site{i}.com/p{i}" for i in range(0, 400, 2)] + [None, "site0.com/p0"]
    urls = [f"https://www.site{i}.com/p{i}/?u={i}#x" for i in range(400)]
    got = judged(spark, urls, listed, max_blocks=blocks)
    assert len(got) == 400
    assert [got[u]["verdict"] for u in urls] == ["block" if i % 2 == 0 else "allow" for i in range(400)]
    assert all(got[u]["listed"] == (i % 2 == 0) for i, u in enumerate(urls))


def test_rule_beats_list_and_empty_tables(spark):
    got = judged(spark, ["http://example.net/en/a"], ["example.net/en/a"])
    assert got["http://example.net/en/a"]["verdict"] == "allow"
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.url_filter(empty, empty.select("url")).collect() == []
    with pytest.raises(ValueError):
        url_filter.rule_column(None, None, (url_filter.RULES[0],) * 1001, "text")


def test_line_dedup_by_site(spark):
    rows = [(i, f"Header\nbody {i}\n\nbody {i}", "a") for i in range(20)]
    rows += [(100 + i, f"Header\nother {i}", "b") for i in range(4)]
    rows += [(200 + i, " Menu \t\nx", None) for i in range(6)]
    rows += [(300, None, "a"), (301, "", "a"), (None, "Header", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["doc_id"]): r for r in line_dedup.line_dedup(df).collect()}
    assert got[3]["text"] == "body 3\n\nbody 3" and (got[3]["dedup_lines"], got[3]["dedup_dropped"]) == (4, 1)
    assert got[101]["text"] == "other 1"
    assert got[205]["text"] == "" and got[205]["dedup_dropped"] == 2
    assert got[300]["text"] is None and got[301]["text"] == "" and got[None]["text"] == ""


@pytest.mark.parametrize("pages", [1, 2, 3, 4, 30])
def test_line_dedup_ratio_decides(spark, pages):
    """From two pages on, the ratio alone tells boilerplate, on sites of any size."""
    rows = [(i, f"All\n{'Two' if i < 2 else f'own {i}'}\n{i}", "a") for i in range(pages)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    few = 1 < pages < 20  # 2 of 20 pages are not more than a tenth
    for i in range(pages):
        second = "Two" if i < 2 else f"own {i}"
        expected = [] if pages > 1 else ["All"]
        expected += [] if few and i < 2 else [second]
        assert got[i] == "\n".join([*expected, str(i)])


def test_line_dedup_edges(edge_docs, no_docs):
    got = line_dedup.line_dedup(edge_docs)
    assert got.count() == edge_docs.count()
    assert {c.lower() for c in edge_docs.columns} <= {c.lower() for c in got.columns}
    assert {r["site_key"] for r in got.collect()} == {"x-site_key"}
    assert line_dedup.line_dedup(no_docs).collect() == []
