import math
import random
import re

import numpy as np
import pyarrow as pa

from sparkloom.llm import langid as l

SYLLABLES = {"xx": "ba ke lo mi tu".split(), "yy": "schn pfe ung ßen ö".split(), "zz": "aux eau oi ç né".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def rows(seed, each=60):
    rng = random.Random(seed)
    return [(i, text(rng, lang, rng.randrange(4, 80)), lang) for i, lang in enumerate(lang for lang in SYLLABLES for _ in range(each))]


def test_held_out_accuracy_and_rejection():
    data = rows(1)
    model = l.train([t for _, t, _ in data], [x for _, _, x in data])
    new = rows(2)
    best, most, good = model.predict(pa.array([t for _, t, _ in new]))
    right = np.array([model.languages[b] == x for b, (_, _, x) in zip(best, new)])
    assert right.mean() >= 0.98 and good.mean() >= 0.97
    assert (most > 0.33).all() and (most <= 1).all()
    strange = ["дом стоит на горе и там живут", "これは 日本語 です", "qqqq wwww rrrr jjjj vvvv", "123 456 ---", "", None]
    _, most, good = model.predict(pa.array(strange, pa.string()))
    assert not good.any() and most[3:].tolist() == [0, 0, 0]


def test_subwords_do_not_depend_on_neighbours():
    one, sizes = l.subwords(pa.array(["abc", "d", "été"]))
    for at, word in enumerate(["abc", "d", "été"]):
        own, n = l.subwords(pa.array([word]))
        start = sizes[:at].sum()
        assert sorted(one[start : start + sizes[at]]) == sorted(own) and n[0] == sizes[at]


def test_means_are_those_of_single_texts():
    data = rows(4, 5)
    model = l.train([t for _, t, _ in data], [x for _, _, x in data])
    texts = [t for _, t, _ in data] + [None, "", "a b", "x"]
    whole, size = model.means(pa.array(texts, pa.string()))
    for t, m, n in zip(texts, whole, size):
        own, k = model.means(pa.array([t], pa.string()))
        assert k[0] == n and np.allclose(own[0], m)


def brute(model, text):
    """Language, probability and acceptance of one text, word by word."""
    total, size = np.zeros(model.table.shape[1]), 0
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for bucket in l.subwords(pa.array([word]))[0]:
            total += model.table[bucket]
            size += 1
    if not size:
        return -1, 0.0, False
    mean = total / size
    scores = [(s + b) / model.temperature for s, b in zip(mean[:-1], model.bias)]
    whole = sum(math.exp(s) for s in scores)
    best = max(range(len(scores)), key=scores.__getitem__)
    most = math.exp(scores[best]) / whole
    return best, most, most >= model.least and mean[-1] >= model.least_seen


def test_softmax_matches_brute_force():
    data = rows(9, 30)
    model = l.train([t for _, t, _ in data], [x for _, _, x in data])
    texts = [t for _, t, _ in rows(10, 12)] + [None, "", "12", "a", "ba ke qq", "Bä-KE lo2mi", "ba " * 300]
    best, most, good = model.predict(pa.array(texts, pa.string()))
    for at, text in enumerate(texts):
        want = brute(model, text)
        assert best[at] == want[0] and abs(most[at] - want[1]) < 1e-5, text
        assert good[at] == want[2] or abs(want[1] - model.least) < 1e-5


def test_on_spark(spark):
    data = rows(5)
    odd = [(None, data[0][1], "xx"), (900, None, "xx"), (901, "", None), (902, "12 34", None), (903, data[0][1], None), (903, data[0][1], None), (904, "bake lomi " * 100_000, None)]
    df = spark.createDataFrame([(*r, "c") for r in data + odd], "doc_id long, text string, lang string, language string")
    out = l.languages(df)
    assert out.columns == ["doc_id", "language", "confidence", "accepted"]
    got = out.collect()
    assert len(got) == len(data) + len(odd)
    by = {r.doc_id: r for r in got}
    assert sum(by[i].language == lang for i, _, lang in data) >= 0.98 * len(data)
    assert [(by[i].language, by[i].accepted) for i in (900, 901, 902)] == [("und", False)] * 3
    assert by[904].language == "xx" and by[903].language == "xx"
    unlabelled = l.languages(df.withColumn("lang", df.language.substr(9, 1)).where("doc_id > 900").selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {(r.language, r.confidence, r.accepted) for r in unlabelled.collect()} == {("und", 0.0, False)}
    assert l.languages(df.limit(0)).count() == 0


def test_sample_is_bounded(spark):
    df = spark.createDataFrame(rows(6, 300), "doc_id long, text string, lang string")
    texts, labels = l.sample(df, "lang", "doc_id", "text", rows=50)
    assert {x: labels.count(x) for x in set(labels)} == {"xx": 50, "yy": 50, "zz": 50}
    assert l.sample(df.repartition(7), "lang", "doc_id", "text", rows=50) == (texts, labels)
