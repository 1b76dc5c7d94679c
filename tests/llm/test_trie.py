"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from tracegraph.llm import prefix_trie


def brute(rows, group=20, heads=4):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    members = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        b = c - int(c / group) * group if c < 0 else c % group  # the remainder has the sign of c
        whole = turns.get(c - b, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, len(whole) == d))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    words = lambda t: len([w for w in t.replace("\x1c", "x").split() if w])
    out = {}
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        saved = (len(m) - 1) * (words(p[-1][1]) if p else 0) + sum(out[k][5] for k in kids.get(p, []))
        leaves = sum(out[k][4] for k in kids.get(p, [])) or 1
        ends = ",".join(map(str, sorted(c for c, end in m if end)))
        up = min(c for c, _ in members[p[:-1]]) if p else None
        out[p] = (min(c for c, _ in m), len(p), up, (len(m), len(kids.get(p, []))), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted((a, d, -1 if u is None else u, *n, lv, s, e) for a, d, u, n, lv, s, e in out.values())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string, prefix string, c long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("piece,flush", [(512, 10**6), (4, 30)])
def test_random_conversations(spark, monkeypatch, piece, flush):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "FLUSH", flush)
    rng = random.Random(piece)
    rows = []
    for c in range(-5, 130):
        start = rng.choice([[], ["a"], ["a", "b b", "c"], ["a", "b b", "c", "d d d", "e", "f", "g g"], list("abcdefghijklmnop")])
        for t, text in enumerate(start[:rng.randint(0, len(start))] + [rng.choice(["x", "y y", ""]) for _ in range(rng.choice([0, 1, 3, 12]))]):
            rows.append((c, t, rng.choice(["user", "user", None]), text))
    rows += [(200 + k, t, "user", "the same conversation") for k in range(40) for t in range(9)]  # a large group of copies
    assert got(prefix_trie.conversation_trie(table(spark, rows))) == brute(rows)


def test_nested_prefixes_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    monkeypatch.setattr(prefix_trie, "SLICE", 32)
    rows = [(c, t, "u", f"turn {t}") for c in range(0, 1200, 20) for t in range(c // 20)] + [(5000, t, "u", f"turn {t}") for t in range(150)]
    assert got(prefix_trie.conversation_trie(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "u", "x"), (20, None, None, None), (20, 1, "u", "b"), (20, 1, "u", "b"), (20, 1, "u", "a"), (33, 0, "", ""), (41, 5, "u", "w " * 50_000), (-7, 0, "u", None)]
    assert got(prefix_trie.conversation_trie(table(spark, rows))) == brute(rows)
    assert prefix_trie.conversation_trie(table(spark, rows[:1])).count() == 0 == prefix_trie.conversation_trie(table(spark, [])).count()


def test_fat_binary_search():
    for a in range(70):
        for b in range(a + 1, 80):
            zeros = {n: (n & -n) for n in range(a + 1, b + 1)}
            assert zeros[prefix_trie.fattest(a, b)] == max(zeros.values())
