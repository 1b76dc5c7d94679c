"""Every registered query of the corpus operators against SQL, a brute-force version or held-out labels."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from tracegraph.llm.line_dedup import common_blocks, dedup_lines
from tracegraph.llm.queries import ORACLES, QUERIES

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SPACE = "\x20\x09-\x0d"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == want


@pytest.mark.parametrize("name,label,least", [("op1_kneser_ney_toxicity", "toxic", 0.9), ("op3_compression_quality", "quality", 0.9)])
def test_held_out(spark, name, label, least):
    got = QUERIES[name](spark, MEDIUM).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert [bool(h) for h in got["held_out"]] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]
    known = got.merge(spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas(), on="doc_id")
    known = known[known["held_out"]]
    y, s = known[label].to_numpy(), known["score"].to_numpy()
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    assert ((pairs > 0) + 0.5 * (pairs == 0)).mean() > least
    assert (known["predicted"] == y).mean() > 0.9


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> i & 1 for g in grams) for i in range(64)]
    return sum(1 << i for i, c in enumerate(bits) if 2 * c > len(grams))


def test_simhash(spark, texts):
    ids = sorted(texts)
    fps = [_fingerprint(texts[i]) for i in ids]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((root(ids[a]), root(ids[b])))
                parent[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash_anchor_covering"](spark, SMALL).collect()}
    assert got == {i: (f"{f:016x}", root(i)) for i, f in zip(ids, fps)}


def _luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out, t = [], text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii(spark, texts):
    for r in QUERIES["op9_pii_spans"](spark, SMALL).collect():
        assert r.base_sha256 == hashlib.sha256(base_spans(texts[r.doc_id]).encode()).hexdigest()


def test_shards(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op8_byte_prefix_shards"](spark, SMALL).collect()}
    size = {i: len((t or "").encode()) + 1 for i, t in texts.items()}
    total, before, slots = sum(size.values()), 0, {}
    for i in sorted(texts):
        shard = min(7, (2 * before + size[i]) * 8 // (2 * total))
        assert (got[i].size, got[i].text_crc32, got[i].shard, got[i].slot) == (size[i], zlib.crc32((texts[i] or "").encode()), shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
        before += size[i]
    assert len(slots) == 8


def test_line_dedup(spark, texts):
    lines = {i: [(a, v.rstrip(" "), len(v.split())) for a, v in enumerate(t.split("\n")) if v.split()] for i, t in texts.items()}
    holders = {}
    for i in sorted(texts):
        for _, v, _ in lines[i]:
            holders.setdefault(v, []).append(i)
    shared = {v for v, h in holders.items() if len(set(h)) > 1}
    body = lambda i: [(p, v, w) for p, (_, v, w) in enumerate(lines[i]) if v in shared]
    for r in QUERIES["op10_patience_line_dedup"](spark, SMALL).collect():
        gone = set().union(*[common_blocks(body(r.doc_id), body(h)) for h in {holders[v][0] for _, v, _ in lines[r.doc_id] if v in shared} - {r.doc_id}])
        at = {lines[r.doc_id][p][0] for p in gone}
        assert r.text == "\n".join(v for a, v in enumerate(texts[r.doc_id].split("\n")) if a not in at)
        assert (r.n_lines, r.n_removed, r.removed_lines) == (len(lines[r.doc_id]), len(at), ",".join(map(str, sorted(at))))


def _stands_earlier(docs, min_words=20):
    """For each document the lines that lie in a run of ``min_words`` words standing in any earlier one, run by run."""
    out = {}
    runs = lambda d: {(i, j) for i in range(len(d)) for j in range(i + 1, len(d) + 1) if sum(len(v.split()) for v in d[i:j]) >= min_words}
    for k, d in enumerate(docs):
        before = {tuple(e[i:j]) for e in docs[:k] for i, j in runs(e)}
        out[k] = sorted({p for i, j in runs(d) if tuple(d[i:j]) in before for p in range(i, j)})
    return out


def test_line_dedup_against_all_earlier(spark):
    rng = np.random.default_rng(7)
    line = [f"{'abcdefghijklmn'[k]} " + " ".join(f"w{k}" for _ in range(n - 1)) for k, n in enumerate([12, 12, 3, 1, 8, 8, 8, 25, 19, 2, 4, 6, 1, 15])]
    line = [v.rstrip() for v in line]
    docs = [[line[0]], [line[1]], [line[0], line[1]], [line[0], line[1]], [line[9], line[3], line[10], line[8], line[3]], [line[8], line[3], line[9], line[10], line[3]]]
    docs += [[line[k] for k in rng.integers(0, len(line), rng.integers(1, 9))] for _ in range(60)]
    df = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.removed for r in dedup_lines(df).collect()}
    assert got[3] == [0, 1] and got == _stands_earlier(docs)


def test_pipeline(spark):
    """Each stage on the rows of the one before, by a plain version in the driver."""
    import corpus_pipeline as cp
    from tracegraph.llm import mixing, quality_model
    from tracegraph.llm.common import table
    from tracegraph.session import land

    docs = table(spark, SMALL, "documents")
    kept = []
    for name, stage in cp.STAGES:
        docs = land(stage(spark, docs, SMALL), name)
        kept.append(docs)
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    assert all(k.columns == ["doc_id", "text", "lang", "source", "n_chars"] for k in kept[:-1])
    full = table(spark, SMALL, "documents")
    scored = quality_model.train(spark, full, table(spark, SMALL, "labels")).score(full)
    assert ids[0] == sorted(r.doc_id for r in scored.filter("score >= 0.5").collect())
    fps = {r.doc_id: _fingerprint(r.text) for r in kept[0].select("doc_id", "text").collect()}
    seen, groups = set(), 0
    for i in ids[0]:
        if i in seen:
            continue
        todo = [i]
        seen.add(i)
        groups += 1
        assert i in ids[1]
        while todo:
            x = todo.pop()
            near = [j for j in ids[0] if j not in seen and (fps[x] ^ fps[j]).bit_count() <= 4]
            seen.update(near)
            todo += near
    assert groups == len(ids[1])
    tokens = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[k:k + min(13, len(w))]) for r in table(spark, SMALL, "benchmark").collect() for w in [tokens(r.text)] for k in range(len(w) - min(13, len(w)) + 1)}
    clean = []
    for r in kept[1].collect():
        w = tokens(r.text)
        hit = {j for k in range(len(w)) if tuple(w[k:k + 13]) in windows for j in range(k, k + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r.doc_id)
    assert ids[2] == sorted(clean)
    want = {r.doc_id: r.taken for r in mixing.mix(kept[2]).collect()}
    got = {}
    for r in kept[3].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(f"[^{SPACE}]+", r.text))
        assert r.n_chars == len(r.text)
    assert got == {k: v for k, v in want.items() if v}
    sizes = kept[4].groupBy("shard").sum("size").toPandas()["sum(size)"].to_numpy()
    assert len(sizes) == 8 and np.ptp(sizes) <= 2 * max(len(r.text.encode()) for r in kept[3].collect()) and ids[3] == ids[4]
