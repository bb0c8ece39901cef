import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowdex.functions.udfs import fnv1a, hash_embedding, html_to_markdown, main_element, page_links, thread_to_markdown, unified_diff
from sparrowdex.functions.web import allowed, is_safe_url, urls
from sparrowdex.operators import retrieval as R
from sparrowdex.operators.search import fuzzy, prefix


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_fuzzy(spark):
    own = names(spark, "getUserProfile", "getUserAvatar", "UserSession", "Settings", "Authenticator", "authenticate", "get_user_profile", None)
    assert [r["name"] for r in fuzzy(own, ["Authentcator"]).collect()] == ["Authenticator", "authenticate"] or "Authenticator" in [r["name"] for r in fuzzy(own, ["Authentcator"]).collect()]
    assert "get_user_profile" in [r["name"] for r in fuzzy(own, ["usr"]).collect()]
    assert {r["name"] for r in prefix(own, ["getuser"]).collect()} == {"getUserProfile", "getUserAvatar"}
    assert [r["name"] for r in prefix(own, ["profile"]).collect()] == ["get_user_profile"]
    got = {r["name"]: r["distance"] for r in fuzzy(names(spark, "store", "strore", "sitten", "sitting"), ["store", "kitten"]).collect() if r["query"] == "kitten"}
    assert got == {"sitten": 1}
    assert fuzzy(own.limit(0), ["x"]).count() == 0


def test_fusion(spark):
    def ranks(ids):
        return spark.createDataFrame([(i, n) for n, i in enumerate(ids, 1)], "id long, rank int")

    assert [r["id"] for r in R.fuse([ranks([1, 2, 99]), ranks([3, 4, 1])], 9).collect()] == [1, 3, 2, 4, 99]
    assert [r["id"] for r in R.fuse([ranks([7, 3]), ranks([3, 7])], 9).collect()] == [3, 7]
    assert R.fuse([ranks([7, 3])], 0).count() == 0


def test_cosine(spark):
    row = spark.range(1).select(*[R.cosine(F.array(*[F.lit(float(x)) for x in a]), F.array(*[F.lit(float(x)) for x in b])).alias(str(i)) for i, (a, b) in enumerate([((1, 2), (1, 2)), ((1, 0), (0, 1)), ((1, 2), (1, 2, 3)), ((0, 0), (1, 1))])]).first()
    assert [round(v, 9) for v in row] == [1, 0, 0, 0]


def test_quantise_keeps_direction(spark):
    rng = np.random.default_rng(0)
    v = [float(x) for x in rng.normal(size=384)]
    row = spark.createDataFrame([(v,)], "v array<float>").withColumn("c", R.quantise(F.col("v"))).select(R.cosine(F.col("v"), R.dequantise(F.col("c"))).alias("k")).first()
    assert row["k"] > 0.999


def test_lexical_quality(spark):
    words = "parser lexer cache budget socket vector ledger crawler".split()
    docs = spark.createDataFrame([(i, f"{words[i % 8]} handling number {i} for the {words[(i * 3) % 8]} with common words") for i in range(50)], "id long, body string")
    hits = 0
    for q, w in enumerate(words[:7]):
        got = [r["id"] for r in R.bm25(docs, f"{w} number {q}", 5).collect()]
        hits += q in got
    assert hits / 7 >= 0.8
    assert R.bm25(docs, "", 5).count() == 0 and R.bm25(docs.limit(0), "cache", 5).count() == 0


def test_modes():
    assert R.SearchMode.parse("RRF") is R.SearchMode.HYBRID
    assert R.SearchMode.parse(None) is R.SearchMode.LEXICAL
    with pytest.raises(ValueError):
        R.SearchMode.parse("other")


def test_delete(spark):
    s = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", 9), (3, "b", "x", 5)], "id long, source_id string, wing string, created_at long")
    assert {r["id"] for r in R.delete(s, source="a").collect()} == {3}
    assert {r["id"] for r in R.delete(s, before=9, wing="x").collect()} == {2}
    assert R.delete(s, everything=True).count() == 0


def test_safe_urls(spark):
    bad = "http://localhost/ http://127.0.0.1/ http://10.1.2.3/ http://172.16.0.1/ http://192.168.1.1/ http://169.254.169.254/ http://[::1]/ http://[fe80::1]/ http://0.0.0.0/ ftp://a.example/ file:///x http://a.localhost/".split()
    good = "https://site.example/ http://1.1.1.1/ http://user:pass@site.example/".split()
    df = spark.createDataFrame([(u,) for u in bad + good + [None]], "u string")
    assert {r["u"] for r in df.filter(is_safe_url(F.col("u"))).collect()} == set(good)


def test_allowlist(spark):
    hosts = spark.createDataFrame([("api.site.example",), ("site.example",), ("site.example.evil.test",), ("EXACT.test.",), ("sub.exact.test",), ("",), (None,)], "host string")
    rules = spark.createDataFrame([("*.site.example",), ("exact.test # one",), ("#",)], "rule string")
    assert {r["host"] for r in allowed(hosts, rules).filter("ok").collect()} == {"api.site.example", "site.example", "EXACT.test."}


def test_urls(spark):
    row = spark.createDataFrame([("see https://a.example/x, http://b.example. and https://a.example/x (https://c.example/y)",)], "t string").select(urls(F.col("t")).alias("u")).first()
    assert row["u"] == ["https://a.example/x", "http://b.example", "https://c.example/y"]


def test_links():
    page = "<a href=\"/about\">1</a><a href='sub/page.html'>2</a><a href=https://other.example/x#frag>3</a><a href='#top'>4</a><a href='mailto:a@b'>5</a><a href='../up?a=1&amp;b=2'>6</a><a href='/about#team'>7</a>"
    assert page_links("https://site.example/dir/index.html", page) == ["https://site.example/about", "https://site.example/dir/sub/page.html", "https://other.example/x", "https://site.example/up?a=1&b=2"]
    assert page_links("nonsense", page) == []


def test_html():
    assert main_element("<div><ARTICLE>a<article>b</article>c</ARTICLE></div><main>m</main>") == "a<article>b</article>c"
    assert main_element("<mainx>n</mainx><main> m </main>") == "m" and main_element("<p>x</p>") is None
    assert html_to_markdown("<h1>T</h1><script>x()</script><p>a <b>c</b> &amp; d</p><ul><li>i</li></ul>") == "# T\n\na **c** & d\n\n* i"
    assert thread_to_markdown("{}") is None


def test_hashes():
    assert fnv1a("") == 0xCBF29CE484222325 and fnv1a("a") == 0xAF63DC4C8601EC8C
    v = hash_embedding("abc")
    assert len(v) == 384 and abs(float(v @ v) - 1) < 1e-5 and (v == hash_embedding("abc")).all()
    assert unified_diff("a\nb", "a\nc").endswith("-b\n+c")
