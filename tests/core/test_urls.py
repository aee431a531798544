import pytest
from pyspark.sql import functions as F

from sparkloom.functions import urls as u


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://Docs.RS/a//", "https://docs.rs/a"),
        ("http://ex.com/", None),
        ("https://user:p@ex.com:8443/a/../b/?b=2&a=1&a=0#f", "https://ex.com/b?a=0&a=1&b=2"),
        ("https://localhost/", None),
        ("https://nodots/", None),
        ("https://1.2.3.4", "https://1.2.3.4/"),
        ("https://[::1]/x", "https://[::1]/x"),
        ("https://ex.com?", "https://ex.com/"),
        ("https://ex.com/?q=a b~", "https://ex.com/?q=a+b%7E"),
        ("https://exämple.com/ü x", "https://xn--exmple-cua.com/%C3%BC%20x"),
        ("https://ex.com:99999/", None),
        ("https://ex.com/\x85", None),
        ("https://ex.com/" + "a" * 2048, None),
        ("", None),
        (None, None),
    ],
)
def test_canonical(raw, want):
    assert u.canonical(raw) == want


RULES = {
    "https://docs.rs/serde": None,
    "https://sub.docs.rs/serde": None,
    "https://example.com/": "host",
    "https://docs.rs/a.tar.gz": "binary",
    "https://meta.stackoverflow.com/questions": "subhost",
    "https://git.kernel.org/x": "subhost",
    "https://llvm.org/doxygen/a": "generated",
    "https://llvm.org/fr-x": "localized",
    "https://llvm.org/a?golang=1": "language",
    "https://llvm.org/a/de/b": "locale",
    "https://en.wikipedia.org/wiki/Linux": None,
    "https://en.wikipedia.org/w/index.php": "wiki_path",
    "https://en.wikipedia.org/wiki/2004_election": "wiki_title",
    "https://en.wikipedia.org/wiki/Cheese": "wiki_title",
    "https://stackoverflow.com/users": "stackoverflow",
    "https://stackoverflow.com/q/1": None,
    "https://en.cppreference.com/w/cpp/vector": None,
    "https://en.cppreference.com/w/Main": "cppreference",
    "https://aws.amazon.com/blogs/x": None,
    "https://aws.amazon.com/s3": "aws",
    "https://www.databricks.com/blog/x": None,
    "https://www.databricks.com/x": "databricks",
    "https://medium.com/x/followers": "medium",
    "https://downloads.haskell.org/ghc/latest/docs": None,
    "https://downloads.haskell.org/other": "ghc_docs",
    "https://gcc.gnu.org/bugzilla/x": "gcc_archive",
    "https://docs.rs/a?utm_x=1": "params",
    "https://docs.rs/a?q=1": None,
}


def test_admission(spark):
    df = spark.createDataFrame([(k,) for k in RULES], "url string")
    got = {r.url: r.why for r in df.select("url", u.rejected_by("url").alias("why")).collect()}
    assert got == RULES


def test_scores_caps_and_keys(spark):
    rust = "doc.rust-lang.org"
    rows = ["https://docs.rs/docs/x?a=1", "https://llvm.org/tag/x", "https://a.b.kernel.org/", f"https://{rust}/beta/std", "https://ex.com/a?b#c"]
    df = spark.createDataFrame([(r,) for r in rows], "url string")
    out = df.select(u.priority("url", F.lit(1)).alias("p"), u.page_cap(u.host("url")).alias("c"), u.url_key("url").alias("k"), u.display_url("url").alias("d")).collect()
    assert [r.p for r in out] == [150, 20, 90, 120, 70]
    assert [r.c for r in out] == [30000, 15000, 20000, 25000, 2000]
    assert out[3].k == "doc.rust-lang.org/std" and out[4].k == "https://ex.com/a"
    assert out[2].d == "a.b.kernel.org" and out[4].d == "ex.com/a"


def test_robots(spark):
    text = "User-agent: x\nDisallow: /x\n# c\nUser-agent: *\nDisallow: /a\nDisallow:\nDISALLOW : /b # note"
    df = spark.createDataFrame([(text,), (None,)], "t string").select(u.parse_robots("t").alias("r"))
    assert [r.r for r in df.collect()] == [["/a", "/b # note"], []]
    allow = lambda p: u.robots_allow(F.lit(p), "r")
    got = df.select(allow("/ab"), allow("/x"), u.robots_allow(F.lit("/a"), F.lit(None).cast("array<string>"))).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (True, True, True)]


def test_private_addresses(spark):
    rows = ["10.1.1.1", "8.8.8.8", "0.0.0.0", "::1", "fe80::1", "169.254.0.1", "x", None]
    df = spark.createDataFrame([(r,) for r in rows], "a string").select(u.is_private("a").alias("p"))
    assert [r.p for r in df.collect()] == [True, False, False, True, True, True, None, None]
