import pytest

from tabprep.llm.queries import QUERIES, URL_RULES
from tabprep.llm.url_filter import Rule, judge, labelled_urls, train
from tabprep.session import materialize_counted

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return train(labelled_urls(spark))


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:end]


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def check(rows):
    for r in rows:
        host, path = parts(r["url"])
        best = rule(host, path)
        assert (r["host"], r["path"]) == (host, path), r["url"]
        assert r["rule"] == (best and best.host + best.path), r["url"]
        assert r["verdict"] == (best.verdict if best else "block" if r["score"] >= 0.7 else "allow")


def test_query_against_plain_python(spark):
    got = QUERIES["op8_url_filter"](spark, SF)
    urls = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    check(got.join(urls, "page_id").collect())
    assert got.count() == urls.count()


def test_odd_urls(spark, model):
    urls = [
        None, "", "no scheme", "http://", "://x", "HTTP://WWW.Example.COM/en/1", "http://example.com/en", "http://a.example.com/en/?q", "http://com",
        "http://com/", "http://xcom/", "http://example.com/EN/", "http://e.net/es/x#y", "http://É.NET/fr/", "a://b://c/d", "http://h?x/y", "http://h#/net/es/",
        "http://x\ny.net/es/", "http://" + "a" * 5000 + ".net/fr/" + "b" * 5000, "http://com/", "http://www.example.com/en/", "http://a.www.example.com/en/x",
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "host int, url string, score string")
    got = judge(df, model, URL_RULES).select("row.url", "host", "path", "rule", "verdict", "score").collect()
    assert len(got) == len(urls)
    check(got)
    assert judge(df.limit(0), model, URL_RULES).count() == 0


def test_unwanted_hosts_that_were_not_in_the_table(spark, model):
    df = spark.createDataFrame(
        [("https://www.casino-spins.example.org/x", 1), ("https://m.spam-links.example.org/", 1), ("https://blog.garden-notes.example.org/en/5", 0), ("https://thenews.example.org/de/2", 0)],
        "url string, bad int",
    )
    for r in judge(df, model, [Rule("none.zz", "/", "allow")]).select("row.bad", "verdict").collect():
        assert r["verdict"] == ("block" if r["bad"] else "allow")


def test_no_python_in_the_plan(spark, model):
    df = spark.createDataFrame([("http://a.b/c",)], "url string")
    plan = judge(df, model, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_judging_after_rows_were_observed(spark, model):
    """Once a session has counted rows while writing them, it can no longer travel to tasks; the model must not hold it."""
    materialize_counted(spark.range(3))
    df = spark.createDataFrame([("http://a.b/c",)], "url string")
    assert judge(df, model, URL_RULES).count() == len(judge(df, train(labelled_urls(spark)), URL_RULES).collect()) == 1
