from urllib.parse import urlsplit

from lavka.llm import url_filter as U
from lavka.llm.queries import URL_RULES, op4_url_filter

SF = "/root/testdata/sf0.001"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return host, rest[:cut]


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = ["http://A.Example.ORG/es/1?x#y", "https://example.org", "x://org/", "http://notorg/", "http://b.org/q", None, "",
        "no scheme", "http://", "http://É.com/fr/ü", "https://m.com/de/", "http://com/de/x://y/z", "http://a.example.org/en/12",
        "http://a.example.org/en/2", "http://h?q=1/2", "http://h#f://x", "ftp://u:p@h:80/a/b;c#", "http://x.net/" + "p/" * 5000]


def test_parts_and_rules(spark):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rows = U.judge(frame, URL_RULES, U.Model([0.0] * 16, 0.0, 4, (3,))).collect()
    for r in rows:
        host, path = plain_parts(URLS[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        assert r.verdict == (rule.verdict if rule else "allow")
    assert urlsplit(URLS[0]).path == plain_parts(URLS[0])[1]


def test_learns_what_the_table_says(spark):
    rows = [(f"http://site{i}.net/{'casino' if i % 2 else 'news'}/{i}", bool(i % 2)) for i in range(200)]
    model = U.train(spark.createDataFrame(rows, "url string, blocked boolean"))
    new = [(i, f"https://other{i}.com/{'casino' if i % 3 else 'news'}/p{i}") for i in range(60)]
    found = U.judge(spark.createDataFrame(new, "page_id long, url string"), [], model).collect()
    assert all((r.verdict == "block") == bool(r.page_id % 3) and 0 <= r.score <= 1 for r in found)


def test_training_does_not_depend_on_the_order_of_rows(spark):
    rows = [(f"http://s{i % 7}.net/{i % 3}/{i}", i % 3 == 0) for i in range(90)]
    one = U.train(spark.createDataFrame(rows, "url string, blocked boolean"), steps=4)
    two = U.train(spark.createDataFrame(rows[::-1], "url string, blocked boolean").repartition(5), steps=4)
    assert one == two


def test_without_labels_everything_is_allowed(spark):
    nothing = spark.createDataFrame([("http://a.net/x", None)], "url string, blocked boolean")
    model = U.train(nothing)
    assert set(model.weights) == {0.0}
    frame = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert U.judge(frame, [], model).first().verdict == "allow"
    assert U.judge(frame.where("1 = 0"), URL_RULES, model).collect() == []


def test_whole_table(spark, tables):
    found = op4_url_filter(spark, SF)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    pages = dict(tables.execute("select page_id, url from pages").fetchall())
    rows = found.collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        host, path = plain_parts(pages[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        assert r.verdict == (rule.verdict if rule else "block" if r.score > 0.5 else "allow")
    assert {r.verdict for r in rows} == {"allow", "block"}


def test_a_hot_url_does_not_fill_the_sample(spark):
    """The URL with the smallest hash, in as many rows as the sample may have and more."""
    rows = [(f"http://site{i}.net/{'casino' if i % 2 else 'news'}/{i}", bool(i % 2)) for i in range(80)]
    host, path = U.url_parts(U.F.col("url"))
    table = spark.createDataFrame(rows, "url string, blocked boolean")
    hot = table.orderBy(U.F.xxhash64(host, path)).first()
    copies = spark.range(400).select(U.F.concat(U.F.lit(f"{hot.url}?"), "id").alias("url"), U.F.lit(hot.blocked).alias("blocked"))
    model = U.train(table.unionByName(copies), max_rows=80)
    new = [(i, f"https://other{i}.com/{'casino' if i % 3 else 'news'}/p{i}") for i in range(60)]
    found = U.judge(spark.createDataFrame(new, "page_id long, url string"), [], model).collect()
    assert all((r.verdict == "block") == bool(r.page_id % 3) for r in found)
