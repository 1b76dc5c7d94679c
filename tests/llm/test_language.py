"""Language identification: n-grams and learning against plain versions, then held-out accuracy."""

import collections
import math
import zlib

import numpy as np
import pytest

from tracegraph.llm import language_id as li
from tracegraph.llm.queries import QUERIES

TEXTS = ["Hello, World! hello", None, "", "12 3-4", "é ü 漢字 a", "Abc abc" * 50, "İstanbul ǅ 𝒳y"]


def grams(text):
    s = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    s = f" {' '.join(s.split(' '))} " if s.strip() else ""
    while "  " in s:
        s = s.replace("  ", " ")
    found = collections.Counter(s[i:i + n] for n in range(1, li.NGRAMS + 1) for i in range(len(s) - n + 1))
    del found[" "]
    return found


def code(gram):
    value = ord(gram[0])
    for n, c in enumerate(gram[1:], 2):
        value = value << 21 | ord(c) if n <= 3 else value * int(li.MIX) + ord(c)
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("piece", [1 << 19, 40, 7])
def test_every_gram_counts_once(monkeypatch, piece):
    monkeypatch.setattr(li, "PIECE", piece)
    vocabulary = sorted({code(x) for t in TEXTS for x in grams(t)})
    look = li.Lookup(np.array(vocabulary, np.int64))
    assert (look(np.random.default_rng(0).integers(-2**62, 2**62, 1000)) == -1).all()
    doc, feature, count = li.counted(TEXTS, look)
    for i, t in enumerate(TEXTS):
        assert dict(zip(feature[doc == i], count[doc == i])) == {vocabulary.index(code(x)): n for x, n in grams(t).items()}
    idf = np.linspace(0.1, 2, len(vocabulary) + 1)
    doc, feature, value = li.rows_of(TEXTS, look, idf)
    want = {vocabulary.index(code(x)): (1 + math.log(n)) * idf[vocabulary.index(code(x))] for x, n in grams(TEXTS[0]).items()}
    norm = math.sqrt(sum(v * v for v in want.values()))
    assert dict(zip(feature[doc == 0], value[doc == 0])) == pytest.approx({k: v / norm for k, v in want.items()})


def test_leader_follows_the_textbook():
    rng = np.random.default_rng(1)
    leader = li.Leader(np.zeros((6, 3)), np.zeros((6, 3)))
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    for _ in range(200):
        f, v, y = rng.choice(6, 3, replace=False), rng.normal(size=3), int(rng.integers(0, 3))
        leader.learn(f, v, y)
        w = {}
        for i in f:
            for k in range(3):
                s = z[i, k]
                w[i, k] = 0.0 if abs(s) <= li.L1 else -(s - math.copysign(li.L1, s)) / ((li.BETA + math.sqrt(n[i, k])) / li.ALPHA + li.L2)
        e = [math.exp(sum(x * w[i, k] for i, x in zip(f, v))) for k in range(3)]
        for i, x in zip(f, v):
            for k in range(3):
                g = (e[k] / sum(e) - (k == y)) * x
                z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / li.ALPHA * w[i, k]
                n[i, k] += g * g
    assert all(leader.z[i, k] == pytest.approx(z[i, k]) and leader.n[i, k] == pytest.approx(n[i, k]) for i in range(6) for k in range(3))
    leader = li.Leader(np.zeros((2, 2)), np.zeros((2, 2)))
    leader.learn(np.array([0, 1]), np.array([1.0, li.L1]), 0)
    assert (leader.weights()[0] != 0).all() and (leader.weights()[1] == 0).all()  # the first norm keeps small sums at zero


def test_temperature():
    rng = np.random.default_rng(2)
    logits, scale = rng.normal(size=(5000, 4)), 3.0
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = np.array([rng.choice(4, p=r) for r in p])
    assert li.fit_temperature(logits * scale, y) == pytest.approx(scale, rel=0.1)
    assert li.fit_temperature(np.zeros((0, 4)), np.zeros(0, int)) == 1.0


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_ftrl_language_id"](spark, sf).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert [bool(h) for h in got["held_out"]] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]
    known = got.merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    known = known[known["held_out"]]
    assert (known["lang"] == known["lang_pred"]).mean() > 0.97
    sure = known[known["score"] > 0.9]
    assert (sure["lang"] == sure["lang_pred"]).mean() > 0.97


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, score double, lang_pred string, key int"
    rows = [(i, t, "xx" if i % 2 else "yy", 0.5, "p", 1) for i, t in enumerate(["the old river runs", "le vieux moulin va"][k % 2] for k in range(60))]
    odd = [(None, "the mill", "xx", None, None, 1), (60, None, "yy", None, None, 1), (61, "", None, None, None, 1), (62, "12 34", "yy", None, None, 1), (63, "漢字", None, None, None, 1),
           (64, "river " * 200_000, None, None, None, 1), (7, "le vieux moulin", "xx", None, None, 1)]
    docs = spark.createDataFrame(rows + odd + odd[-1:] * 3, schema)
    got = li.train(docs).predict(docs)
    assert got.columns == [*docs.columns, "lang_pred_", "score_"] and got.count() == docs.count()
    by = {r.doc_id: (r.lang_pred_, r.score_) for r in got.collect()}
    assert by[60] == by[61] == by[62] == ("und", 0.0) and by[63][0] in ("xx", "yy") and by[64][0] == "yy"
    for none in (docs.limit(0), docs.withColumn("lang", docs["lang_pred"].substr(9, 9)).filter("lang = 'no'")):
        assert li.train(none).predict(docs).filter("lang_pred_ <> 'und' OR score_ <> 0").count() == 0
    assert li.train(docs).predict(docs.limit(0)).count() == 0
