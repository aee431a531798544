import pytest

from sparkloom.functions import register, serp
from sparkloom.operators import crawl, embedders, pages
from sparkloom.plans import engine
from sparkloom.sources import config, records, sinks

PROSE = "<p>" + "Some words that make the page long enough to be kept. " * 9 + "</p><p>And one more block of text stands here.</p>"


def site(spark, links, rest=()):
    page = lambda own: f"<html><body><h1>H</h1>{PROSE}{''.join(f'<p>A link with enough text around it to stay in: <a href={u}>x</a></p>' for u in own)}</body></html>"
    rows = [(u, u, page(own)) for u, own in links.items()]
    return spark.createDataFrame([*rows, *rest], "url string, final_url string, html string")


def names(df, column="url"):
    return sorted(r[column] for r in df.collect())


def test_a_crawl_to_its_end(spark):
    d = "https://docs.rs/"
    fetched = site(spark, {d + "a": [d + "b", d + "c", "https://ex.com/"], d + "b": [d + "a", d + "e"], d + "e": []}, [(d + "c", d + "c2", "<p>short <a href='/f'>f</a></p>")])
    seeds = spark.createDataFrame([(d + "a",), ("http://docs.rs/plain",)], "url string")
    state, reports = crawl.crawl(crawl.empty_state(spark), fetched, 7, seeds, per_host=2)
    assert names(state["content"]) == [d + "a", d + "b", d + "e"] == names(state["normalize_queue"])
    assert names(state["seen"]) == [d + x for x in ("a", "b", "c", "c2", "e", "f")] and state["to_crawl"].count() == 0
    assert names(state["domains"], "key") == ["docs.rs", d + "a", d + "b", d + "e"]
    assert [(r["fetched"], r["accepted"], r["rejected"], r["queued"]) for r in reports] == [(1, 1, 0, 2), (2, 1, 1, 2), (2, 1, 1, 0)]


def test_bounds_of_a_crawl(spark):
    d = "https://docs.rs/"
    fetched = site(spark, {d + str(i): [d + str(i + 1)] for i in range(9)})
    queued = spark.createDataFrame([(d + str(i), 0) for i in range(9)] + [("https://ex.com/x", 0)], "url string, depth int")
    state, reports = crawl.crawl(crawl.empty_state(spark, to_crawl=queued), fetched, 7, max_pages=4)
    assert state["content"].count() == 4 and len(reports) == 1
    again, more = crawl.crawl(state, fetched, 8, max_pages=4)
    assert more == [] and again["content"].count() == 4
    capped = site(spark, {f"https://uops.info/{i}": [] for i in range(3)})
    full = spark.createDataFrame([(f"https://uops.info/x{i}", "t", None, []) for i in range(499)], crawl.SCHEMAS["content"])
    state = crawl.empty_state(spark, content=full, to_crawl=capped.selectExpr("url", "0 as depth"))
    state, _ = crawl.persist(state, crawl.next_wave(state, 10), capped, 7)
    assert state["content"].count() == 500


def test_recovery_and_robots(spark):
    d = "https://docs.rs/"
    queued = spark.createDataFrame([(d + "a", 5), (d + "b", 2), (d + "no/x", 1), ("https://ex.com/", 1)], "url string, depth int")
    robots = spark.createDataFrame([("docs.rs", ["/no/"])], "host string, disallow array<string>")
    seen = spark.createDataFrame([(d + "b",)], "url string")
    state, told = crawl.recover(crawl.empty_state(spark, to_crawl=queued, robots=robots, seen=seen))
    assert [tuple(r) for r in state["to_crawl"].collect()] == [(d + "a", 0)] and tuple(told.first()) == (1, 3)


def test_the_queue_of_pages_to_chunk(spark):
    block = lambda *texts: [(["H"], t) for t in texts]
    content = spark.createDataFrame([("u1", "t", None, block("New text.")), ("u2", "t", None, block("Other."))], crawl.SCHEMAS["content"])
    old = pages.chunk_records(spark.createDataFrame([("u1", "t", None, block("Old one.", "Old two.")), ("u2", "t", None, block("Other."))], crawl.SCHEMAS["content"]))
    queue = spark.createDataFrame([("u1",), ("gone",)], "url string")
    state, chunks = crawl.normalize(crawl.empty_state(spark, content=content, normalize_queue=queue), old)
    assert sorted((r.source_url, r.text) for r in chunks.collect()) == [("u1", "H\nNew text."), ("u2", "H\nOther.")]
    assert state["normalize_queue"].count() == 0


def test_harvest_counts(spark):
    links = spark.createDataFrame([("https://a.com/x",), ("https://a.com/x#y",), ("https://a.com/z",), ("bad",)], "url string")
    seen = spark.createDataFrame([("https://a.com/z",)], "url string")
    assert tuple(records.enqueue_counts(links, seen, seen.limit(0)).first()) == (1, 2)
    assert tuple(records.enqueue_counts(links.limit(0), seen, seen).first()) == (0, 0)


def test_tables_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for profile in sinks.PROFILES:
        sinks.save_table(df, f"{tmp_path}/t", profile)
        assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    assert sinks.clear_table(spark, f"{tmp_path}/t") == 2 and spark.read.parquet(f"{tmp_path}/t").columns == ["k", "v"]
    (tmp_path / "file").write_text("x")
    with pytest.raises(ValueError):
        sinks.save_table(df, f"{tmp_path}/file")
    sinks.save_report(spark, [{"name": "x", "seconds": 1.5}], f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first().seconds == 1.5
    labels = spark.createDataFrame([("s", "a", None, None, 1), ("bad", None, None, None, 7)], "current_sentence string, prev_1 string, prev_2 string, prev_3 string, label int")
    sinks.append_labels(labels, f"{tmp_path}/labels")
    assert spark.read.json(f"{tmp_path}/labels").count() == 1
    read = records.read_wiki(spark, _lines(tmp_path))
    assert [r.title for r in read.collect()] == ["A"]


def _lines(tmp_path):
    (tmp_path / "wiki.jsonl").write_text('{"title":"A","summary":"s"}\nnot json\n')
    return f"{tmp_path}/wiki.jsonl"


def test_functions_in_sql(spark):
    assert "split_chunks" in register.register(spark)
    spark.createDataFrame([(1, "One is here. Two is here. Three is here. Four is here.")], "id int, t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT c.position, c.window FROM texts, LATERAL split_chunks(t) AS c ORDER BY 1").collect()
    assert [tuple(r) for r in got] == [(0, "One is here. Two is here. Three is here."), (1, "Three is here. Four is here.")]
    assert spark.sql("SELECT canonical_url('HTTPS://A.com/b/#c')").first()[0] == "https://a.com/b"


def test_pages_of_results(spark):
    rows = [(1, "a <q>", 1, "https://e.com/x?y", ["H & I", "J"], "text of a q", 0.25)]
    results = spark.createDataFrame(rows, "query_id long, query string, rank int, source_url string, heading_chain array<string>, text string, score double")
    panels = spark.createDataFrame([(1, "T<", "S", None, "i.png")], "query_id long, title string, summary string, description string, image_url string")
    own = serp.result_rows(results, panels, "key", 5).collect()
    assert own[0].breadcrumbs == ["H &amp; I", "J"] and own[0].display_url == "e.com/x" and own[0].score == "0.2500" and own[0].panel_title == "T&lt;"
    assert serp.read_token(own[0].href.removeprefix("/act?d="), "key", 5)["position"] == 1
    page = serp.result_page("a <q>", own, 1500)
    assert "a &lt;q&gt;" in page and "(1.50 seconds)" in page and "T&lt;" in page and "i.png" in page and "<q>" not in page
    assert "Nothing found" in serp.result_page("x", [])


def test_the_engine_from_settings(spark, tmp_path):
    topics = {"sorting": "Quick sort splits the array. ", "hashing": "A hash table stores keys in buckets. ", "graphs": "Breadth first search visits nodes by distance. "}
    rows = [(f"https://docs.rs/{t}", f"<html><head><title>{t}</title></head><body><h1>{t}</h1>" + "".join(f"<p>{s * 3} Paragraph {i} tells more of {t} than the last one did.</p>" for i in range(6)) + "</body></html>") for t, s in topics.items()]
    df = spark.createDataFrame(rows, "url string, html string")
    asked = spark.createDataFrame([(1, "hash table buckets"), (2, "breadth search nodes")], "query_id long, text string")
    found = {}
    for backend in ("bruteforce", "cells"):
        settings = config.Config(embedding=config.Embedding(dim=64), index=config.Index(backend, 4, 4))
        own = engine.Engine.build(spark, df, f"{tmp_path}/{backend}", settings)
        found[backend] = sorted(map(tuple, engine.Engine(spark, f"{tmp_path}/{backend}", settings).search(asked, 3).collect()))
    assert found["bruteforce"] == found["cells"]
    assert {(r[0], r[4]) for r in found["cells"] if r[1] == 1} == {(1, "https://docs.rs/hashing"), (2, "https://docs.rs/graphs")}
    own.add_articles(spark.createDataFrame([('{"title":"Hash table","summary":"hash table buckets"}',)], "value string"))
    assert [(r.query_id, r.title) for r in own.panels(asked).collect()] == [(1, "Hash table")]
    assert pages.leaf_sample(own.chunks, 2).count() == 2
    with pytest.raises(ValueError):
        engine.Engine(spark, f"{tmp_path}/cells", config.Config(embedding=config.Embedding(dim=32)), embedders.named("hashing", 64))
