"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from test_queries import base_spans
from tracegraph.llm import decontaminate, line_dedup, mixing, pii, quality_model, quality_rules, sharding, simhash, toxicity, warc
from tracegraph.llm.common import land
from tracegraph.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, row string, pii string, size string, shard string, removed string, kept string"
LONG = " ".join(f"w{i % 977} and" for i in range(60_000))
TEXTS = [None, "", " \n\t", "one", LONG, LONG, "Same words in every copy of it here.\n" * 3, "Same words in every copy of it here.\n" * 3,
         "é ü 漢字 𝒳 mail a@b.co or +1 (555) 010-9999", "4111 1111 1111 1111\n" + "1 " * 30_000, "x@y." + "z." * 20_000 + "q"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i in (3, 6) else i // 2, t, None, None if i % 3 == 0 else f"s{i % 3}", None, 0.5, "fp", "row", "pii", "size", "shard", "r", "k") for i, t in enumerate(TEXTS)]
    rows += [rows[8], rows[8]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 1, 1), (0, None, None), (1, 1, 0), (1, 0, 0), (2, 0, 1), (3, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd, none, labels):
    for docs in (odd, none):
        for lab in (labels, labels.limit(0)):
            got = toxicity.train(spark, docs, lab).score(docs)
            assert got.columns == [*docs.columns, "score_"] and got.count() == docs.count()
            assert got.filter("score_ NOT BETWEEN 0 AND 1 OR score_ IS NULL").count() == 0


def test_toxicity_finds_rare_forms(spark):
    plain = "the river runs past the old mill and the road goes on to town "
    docs = [(i, plain * 3 + (f" grumblok{'abcdefgh'[i % 8]}s you" if i % 2 else " nice you")) for i in range(200)]
    df = spark.createDataFrame(docs + [(1001, plain + "grumblokzz"), (1002, plain + "friendly")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.train(spark, df, lab).score(df).collect()}
    assert got[1001] > 0.7 > 0.5 > got[1002]


def test_toxicity_in_many_mild_words_and_in_phrases(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]  # 60 mild ones in each half, each some times likelier in its class
    share = lambda y: np.r_[np.full(60, 0.2 + 0.6 * y), np.full(60, 0.8 - 0.6 * y)] / 60
    mild = [(i, " ".join(rng.choice(words, 40, p=share(i % 2)))) for i in range(400)]
    phrase = [(i, " ".join(("cold river" if (j + i) % 2 else "old mill") if i % 2 else ("cold mill" if (j + i) % 2 else "old river") for j in rng.integers(0, 2, 20))) for i in range(400)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    for docs in (mild, phrase):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r.doc_id: r.score for r in toxicity.train(spark, df, lab).score(df).collect()}
        assert np.mean([(got[i] > 0.5) == i % 2 for i in range(300, 400)]) > 0.95


def test_toxicity_keeps_every_gram(spark):
    near = [97 + 256 * k for k in range(3)]
    counts = spark.createDataFrame([(g + 8388593 * j, 1 + j, 2) for g in near for j in range(4)], "gram long, toxic long, ordinary long")
    got = {r.key for r in toxicity.evidence_table(counts).collect()}
    assert {g + 8388593 * j for g in near for j in range(4)} < got


def test_account_number_before_other_tokens(spark):
    number = "DE89 3704 0044 0532 0130 00"
    texts = [f"{number}{after}" for after in (" BIC COBADEFFXXX", " 2024", " GB82 WEST 1234 5698 7654 32", ", paid", "")] + ["DE88 3704 0044 0532 0130 00 BIC"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s.text for s in r.pii if s.kind == "iban"] for r in pii.find_pii(docs).collect()}
    assert got == {0: [number], 1: [number], 2: [number, "GB82 WEST 1234 5698 7654 32"], 3: [number], 4: [number], 5: []}


def test_quality(spark, odd, none, labels):
    for docs in (odd, none):
        for lab in (labels, labels.limit(0)):
            got = quality_model.train(spark, docs, lab).score(docs)
            assert got.count() == docs.count() and got.filter("score_ NOT BETWEEN 0 AND 1 OR score_ IS NULL").count() == 0
    assert quality_model.keep_good(spark, odd, labels.limit(0)).columns == odd.columns


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200
    rows = [(1, "u1", body), (2, None, body), (2, None, body), (None, "u\r\nX: y", body), (5, "u5", None), (6, "u6", ""), (7, "u7", "short"), (8, "u8", "short"),
            (9, "u9", "é" * 3_000_000), (-3, "u", "\x1f\x8b\x08 not a record"), (3, "u", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_pages(spark, pages, split_bytes=1000).collect()
    assert len(got) == len(rows)
    revisits = sorted((r.record_id, r.refers_to, r.payload_bytes) for r in got if r.record_type == "revisit")
    assert revisits == [("urn:key:", "urn:key:1", 203), ("urn:key:2", "urn:key:1", 203), ("urn:key:2", "urn:key:1", 203)]
    assert {r.record_id: r.payload.decode() for r in got if r.record_type == "response"} == {f"urn:key:{k}": h or "" for k, _, h in rows if k not in (2, None)}
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_warc_headers_of_any_length(spark):
    rng = np.random.default_rng(1)
    pages = spark.createDataFrame([(1, "u1", "<p>one"), (2, "data:" + rng.bytes(1_500_000).hex(), "<p>two"), (3, "u3", "<p>three")], "page_id long, url string, html string")
    got = warc.archive_pages(spark, pages.coalesce(1)).collect()
    assert sorted((r.record_id, r.payload) for r in got) == [("urn:key:1", b"<p>one"), ("urn:key:2", b"<p>two"), ("urn:key:3", b"<p>three")]
    with pytest.raises(ValueError, match="lost records"):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(warc, "read_archives", lambda s, man, b: s.createDataFrame([], warc.RECORD))
            warc.archive_pages(spark, pages)


def test_warc_ranges(tmp_path):
    import random

    rng, path, want = random.Random(1), str(tmp_path / "x.warc.gz"), []
    pack = lambda body, level, key: (lambda c: c.compress(warc._record(key, "u", None, "d", len(body), body)) + c.flush())(zlib.compressobj(level, 8, 31))
    inner = b"".join(pack(b"hello", 3, f"in{i}") for i in range(3))
    with open(path, "wb") as f:
        for i in range(60):
            body = inner + rng.randbytes(50) if i % 7 == 0 else rng.randbytes(rng.choice([0, 10, 5000, 200_000])) if i % 3 else warc.MAGIC * rng.randint(0, 50)
            want.append((f.tell(), body))
            f.write(pack(body, 0 if i % 7 == 0 else 3, f"r{i}"))
        size = f.tell()
    for step in (1 << 30, 70_001, 5003):
        assert [(r[1], r[-1]) for s in range(0, size, step) for r in warc.records_in(path, s, s + step)] == want


def test_clashing_names_are_told_apart(spark, odd, none, tmp_path):
    carried = ["size", "shard", "slot", "text_crc32", "taken"]
    docs = odd.withColumns({"slot": F.lit("s"), "text_crc32": F.lit("t"), "taken": F.lit("x")})
    for got in (sharding.shard_by_bytes(docs, 3, carry=carried), mixing.mix(docs, carry=carried)):
        assert len({c.lower() for c in got.columns}) == len(got.columns) and set(carried) < set(got.columns)
        got.write.parquet(str(tmp_path / f"t{len(got.columns)}"))
    assert {r.size for r in sharding.shard_by_bytes(docs, 3, carry=carried).collect()} == {"size"}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.filter("text IS NULL OR size <> 'size'").count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, odd, none):
    """Earlier results stay readable, and odd rows and names pass."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    first = cp.near_duplicate_stage(spark, odd, sf)
    second = cp.decontamination_stage(spark, first, sf)
    third = cp.mixing_stage(spark, second, sf)
    fourth = cp.sharding_stage(spark, third, sf)
    assert first.columns == second.columns == third.columns == odd.columns and first.count() == second.count() == 7
    assert fourth.count() == third.count() and set(odd.columns) < set(fourth.columns) and first.count() == 7
    for stage in (cp.near_duplicate_stage, cp.decontamination_stage, cp.mixing_stage, cp.sharding_stage):
        assert stage(spark, none, sf).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    """More rows of a class than any cap; sparse ids, dense ones and names alike."""
    from tracegraph.llm.calibrate import Logistic, fit_whole_curve

    ids = spark.range(64_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), (F.col("id") % 50 == 0).cast("int").alias("toxic"))
    for docs in (ids, ids.limit(400).withColumn("doc_id", F.col("doc_id") * (1 << 40)), ids.limit(400).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))):
        docs = land(docs, "ids")
        model = toxicity.train(spark, docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
        known = toxicity.training_labels(docs, "toxic").filter(~toxicity.for_curve()).count()
        assert spark.read.parquet(*model.paths[1]).count() == known + 1  # a word after the start for each of them, and the start

    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) * [1, 5, 0.1] + [0, 2, 7]
    y = (x @ [1, 0.3, 4] + rng.normal(size=500) > 29).astype(int)
    got = fit_whole_curve(spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "y int, x array<double>"), 3)
    assert np.allclose(got(x), Logistic.fit(x, y.astype(float))(x), atol=1e-6)
    none = spark.createDataFrame([], "y int, x array<double>")
    assert fit_whole_curve(none, 3)(x[:2]).tolist() == [0.5, 0.5]


def test_toxicity_word_pairs_lie_in_pieces(spark, monkeypatch):
    """A task holds one file of word pairs at a time: files are small, their keys ordered and apart, and scores the same."""
    import pyarrow.parquet as pq
    from tracegraph.llm.warc import open_file

    rng = np.random.default_rng(4)
    docs = land(spark.createDataFrame([(i, " ".join(rng.choice(list("abcdefghijklmnop") + ["ill"] * (i % 3 == 0), 30))) for i in range(300)], "doc_id long, text string"), "docs")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    score = lambda model: {r.doc_id: r.score for r in model.score(docs).collect()}
    want = score(toxicity.train(spark, docs, labels))
    monkeypatch.setattr(toxicity, "PIECE", 20)
    model = toxicity.train(spark, docs, labels)
    files = []
    for path in model.paths[1]:
        with open_file(path, "rb") as file:
            files.append(pq.read_table(file)["key"].to_pylist())
    filled = sorted(f for f in files if f)
    assert len(filled) > 5 and max(map(len, filled)) <= 60 and all(f == sorted(f) for f in filled)
    assert all(a[-1] < b[0] for a, b in zip(filled, filled[1:]))
    assert score(model) == want


def test_texts_are_not_shuffled_for_decisions(spark):
    """Near-duplicates and the mix ask wide rows for their number, however many are kept."""
    from tracegraph.llm.common import asked, bitmaps

    rng = np.random.default_rng(9)
    numbers = sorted({int(b) << 33 | int(n) for b, n in zip(rng.integers(0, 3, 3000), rng.integers(0, 100_000, 3000))})
    rows = spark.createDataFrame([(n,) for n in numbers], "row long")
    got = asked(rows, "row", bitmaps(rows.filter("row % 3 <> 1"), "row", third=F.col("row") % 3 == 0, kept=F.lit(True)))
    assert {(r.row, r.third, r.kept) for r in got.collect()} == {(n, n % 3 == 0, n % 3 != 1) for n in numbers}

    docs = spark.createDataFrame([(i, f" a{i} " + "b c  d " * (i % 40), "xyz"[i % 3], i) for i in range(3000)], "doc_id long, text string, source string, n_chars long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (simhash.drop_near_duplicates(docs), mixing.mixed(docs)):
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
            rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    taken = {r.doc_id: (r.size, r.copies, r.cuts) for r in mixing.mix(docs).collect()}
    whole = {r.doc_id: r.text for r in docs.collect()}
    want = sorted((i, t) for i, (size, n, cuts) in taken.items()
                  for t in [whole[i]] * (n if size else 0) + ([mixing._cut(whole[i], [c.asDict() for c in cuts], re.compile(mixing.WORD))] if cuts else []))
    assert sorted((r.doc_id, r.text) for r in rows) == want and len({t for _, t in want if t not in whole.values()}) > 5


def test_mix(spark, odd, none):
    got = mixing.mix(odd, carry=odd.columns).collect()
    assert len(got) == odd.count() and all(0 <= r["taken"] <= 2 * r[len(odd.columns) + 1] for r in got)
    assert sorted(map(str, mixing.mix(odd.repartition(7)).collect())) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.mix(none).count() == 0


def test_sainte_lague_is_webster(spark):
    rng = np.random.default_rng(5)
    groups = []
    for g in range(12):
        values = rng.integers(0, 1000, rng.integers(1, 30)).tolist() if g else [0, 0, 0]
        groups.append((g, values, int(rng.integers(0, 400))))
    rows = [(g, i, v, s) for g, vs, s in groups for i, v in enumerate(vs)]
    got = {(r.g, r.i): r.quota for r in mixing.sainte_lague(spark.createDataFrame(rows, "g int, i int, v long, s long"), "v", "s", ["g"], ["i"]).collect()}
    for g, vs, s in groups:
        seats = [0] * len(vs)
        for _ in range(s if sum(vs) else 0):
            best = max(range(len(vs)), key=lambda i: (vs[i] / (2 * seats[i] + 1), -i))
            seats[best] += 1
        assert [got[g, i] for i in range(len(vs))] == seats


def test_simhash(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.fp, set()).add(r.component)
    assert all(len(v) == 1 for v in by.values()) and 0 in by
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(by) == 7
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("limit", [4096, 64])
def test_anchor_covering_loses_no_link(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "HOME_LIMIT", limit)
    rng = np.random.default_rng(3)
    fps = [int(b) for b in rng.integers(0, 2**63, 200, dtype=np.uint64)]
    for x in fps[:20]:
        for _ in range(10):
            for k in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(k)
            fps.append(x)
    for _ in range(500):
        x = fps[0]
        for k in rng.integers(0, 64, rng.integers(1, 4)):
            x ^= 1 << int(k)
        fps.append(x)
    fps = sorted(set(fps))
    label = list(range(len(fps)))
    arr = np.array(fps, dtype=np.uint64)
    changed = True
    near = [np.flatnonzero(np.bitwise_count(arr ^ f) <= 4) for f in arr]
    while changed:
        new = [min(label[j] for j in n) for n in near]
        changed, label = new != label, new
    table = land(spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "key long, fp long"), "x")
    assert {r.key: r.component for r in simhash.with_components(table).collect()} == dict(enumerate(label))


def test_components_of_a_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(7, 7), (900, 901), (901, 900)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 901: 900}
    assert components(links.limit(0)).count() == 0


def test_decontamination(spark, none):
    item = [f"q{i}" for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(item)), (1, "tiny Item"), (None, "lone"), (3, None), (4, ""), (5, " ".join(item))], "item_id long, text string")
    docs = [("a", "start " + ", ".join(item[2:16]).upper() + " end"), ("b", "a tiny, item. here " + "pad " * 100), ("c", None), ("d", ""), ("e", " ".join(item[:12])),
            ("f", "lone " * 3), ("g", "lone " * 3), ("h", LONG)]
    df = spark.createDataFrame([Row(row=i, doc_id=k, text=t) for i, (k, t) in enumerate(docs)], "row long, doc_id string, text string")
    got = {docs[r.row][0]: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(spark, df, items).collect()}
    assert got == {"a": (16, 14, ["1", "5"], True), "b": (104, 2, ["1"], False), "c": (0, 0, [], False), "d": (0, 0, [], False), "e": (12, 0, [], False),
                   "f": (3, 3, [""], True), "g": (3, 3, [""], True), "h": (120_000, 0, [], False)}
    assert decontaminate.contamination(spark, df, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(spark, none, items).count() == 0
    kept = decontaminate.drop_contaminated(spark, df.withColumn("term", F.lit(1)), items)
    assert kept.columns == ["row", "doc_id", "text", "term"] and sorted(r.doc_id for r in kept.collect()) == ["b", "c", "d", "e", "h"]


def test_proximity(spark):
    words = decontaminate.item_terms(spark.createDataFrame([(1, "red fox den"), (2, "absent fox")], "item_id long, text string"))
    docs = spark.createDataFrame([(0, "the fox left its red warm den and a fox"), (1, "red x x x x x x x fox den"), (2, "den fox red")], "row long, text string")
    postings, _ = decontaminate.build_index(spark, docs, words)
    got = {(r.row, r.start, r.end) for r in decontaminate.proximity_matches(postings, words, 6).collect()}
    assert got == {(0, 1, 7), (0, 4, 10), (2, 0, 3)}


def test_rules(spark, odd, none):
    got = quality_rules.clean_lines(odd)
    assert set(got.columns) >= {"n_words", "kept", "cleaned", "score", "size"} and got.count() == odd.count()
    blank = got.filter("text IS NULL OR trim(text) = ''").collect()
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in blank)
    long = got.filter(F.length("text") > 300_000).first()
    assert long.n_words == 120_000 and long.n_repeat_words == 120_000
    assert quality_rules.clean_lines(none).count() == 0
    page = "Home | About | Contact\n" + "A line of ordinary prose, long enough to count as text. " * 8 + "\nAll rights reserved."
    r = quality_rules.clean_lines(spark.createDataFrame([(page,)], "text string"), max_lost=0.5).first()
    assert r.cleaned == page.split("\n")[1] and r.lost_words == 8


def test_shards(spark, odd, none):
    got = sharding.shard_by_bytes(odd, 3, carry=["size", "shard"]).collect()
    assert len(got) == odd.count() and {r[-2] for r in got} <= {0, 1, 2}
    for s in {r[-2] for r in got}:
        assert sorted(r[-1] for r in got if r[-2] == s) == list(range(sum(r[-2] == s for r in got)))
    assert sharding.shard_by_bytes(none).count() == 0


def test_pii(spark, odd, none):
    texts = [*TEXTS, "a@b.c.d_e@f.g x", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "a" * 50_000 + "@b.c", " ".join(["a.b@c.de"] * 2000), "9" * 50_000, "a@@b.c@d.e",
             "GB82 WEST 1234 5698 7654 32 is the iban", "GB82 WEST 1234 5698 7654 33 is the iban"]
    got = pii.redact(pii.find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))).collect()
    for r in got:
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.pii if s["rank"] < pii.BASE) == base_spans(r.text)
        assert all(r.text[s.start:s.end] == s.text for s in r.pii)
    assert [s.kind for s in got[-2].pii] == ["iban"] and not got[-1].pii and got[-2].redacted == "[iban] is the iban"
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(none).count() == 0


def test_recall_by_kind(spark):
    rng, n = np.random.default_rng(9), 60
    pick = lambda a, k: "".join(rng.choice(list(a), k))

    def card():
        body = pick("0123456789", 15)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def luhn(x):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(x))) % 10 == 0

    def iban():
        body = pick("0123456789", 18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    planted = {"email": lambda: f"{pick('abcdef', 6)}@{pick('xyz', 5)}.com", "ip": lambda: ".".join(str(v) for v in rng.integers(0, 256, 4)), "card": card,
               "phone": lambda: f"+1 (555) 01{pick('0123456789', 1)}-{pick('0123456789', 4)}", "iban": iban, "secret": lambda: f'token = "{pick("0123456789abcdef", 40)}"'}
    rows = [(i, k, f"the river runs {planted[k]()} past the mill") for k in planted for i in range(n)]
    clean = [f"the river runs past {w} and {'x' * 60} and {'1234567890' * 5} and antidisestablishmentarianism-of-the-old-mill-road" for w in ("here", "key", "token")]
    docs = spark.createDataFrame(rows + [(i, "none", t) for i, t in enumerate(clean)], "doc_id long, kind string, text string")
    hit = {}
    for r in pii.find_pii(docs).collect():
        hit.setdefault(r.kind, []).append(r.kind in {s.kind for s in r.pii} if r.kind != "none" else "secret" in {s.kind for s in r.pii})
    assert all(np.mean(v) > 0.9 for k, v in hit.items() if k != "none") and not any(hit["none"])


def test_kneser_ney_against_dictionaries(spark):
    """Every gram's evidence by plain counting."""
    from collections import Counter, defaultdict

    rng = np.random.default_rng(6)
    docs = [(i, " ".join("".join(rng.choice(list("abé"), rng.integers(1, 6))) for _ in range(rng.integers(1, 12)))) for i in range(50)]
    y = {i: int(rng.integers(0, 2)) for i in range(30)}
    counts, seen = {0: Counter(), 1: Counter()}, set()
    for i, text in docs:
        for w in toxicity.words_of(text):
            b = b"\x01" + w.encode() + b"\x02"
            grams = [b[max(0, k - toxicity.ORDER + 1):k + 1] for k in range(1, len(b))]
            seen.update(grams)
            if i in y:
                counts[y[i]].update(grams)
    full = lambda x: x.rjust(toxicity.ORDER, b"\0")
    kinds = {n: Counter(x[1:] for x in {full(s)[-n - 1:] for s in seen}) for n in range(1, toxicity.ORDER)}
    total, many = {n: Counter() for n in kinds}, {n: Counter() for n in kinds}
    for n, k in kinds.items():
        for x, c in k.items():
            total[n][x[:-1]] += c
            many[n][x[:-1]] += 1

    def shared(x):
        p = 1 / 256
        for n in range(1, toxicity.ORDER):
            s = x[-n:]
            p = (max(kinds[n][s] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * many[n][s[:-1]] * p) / total[n][s[:-1]]
        return p

    want, context = {}, {c: defaultdict(Counter) for c in (0, 1)}
    for c in (0, 1):
        for s, k in counts[c].items():
            context[c][full(s)[:-1]][s] += k
    weight = lambda c, h: toxicity.DISCOUNT * len(context[c][h]) / sum(context[c][h].values()) if context[c][h] else 1.0
    for s in set(counts[0]) | set(counts[1]):
        h = full(s)[:-1]
        p = {c: (max(counts[c][s] - toxicity.DISCOUNT, 0) / sum(context[c][h].values()) if context[c][h] else 0.0) + weight(c, h) * shared(full(s)) for c in (0, 1)}
        want[int.from_bytes(full(s), "big")] = np.log(p[1] / p[0])
    df = spark.createDataFrame([(t, y.get(i)) for i, t in docs], "text string, y int")
    got = {r.key: r.ratio for r in toxicity.evidence_table(df.mapInArrow(toxicity.count_grams, "gram bigint, toxic bigint, ordinary bigint")).collect()}
    assert {k: got[k] for k in want} == pytest.approx(want)
    assert len(got) == len(want) + len({h for c in (0, 1) for h in context[c] if context[c][h]})


def test_line_dedup(spark, odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.count() == odd.count() and "removed_" in got.columns
    assert got.filter("text IS NULL AND n_removed = 0").count() == 1 and line_dedup.dedup_lines(none).count() == 0
    block = [f"line {k} of the passage has quite some words" for k in range(4)]
    docs = [(1, "\n".join(["own start", *block, "own end"])), (2, "\n".join([*block[2:], "between", *block[:2]])), (3, block[0] + "\nfine"), (None, "\n".join(block))]
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=18).collect()}
    assert kept == {1: docs[0][1], 2: "between", 3: docs[2][1], None: ""}
