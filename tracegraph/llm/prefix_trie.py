"""Prefix trie of conversations, built as z-fast tries of bounded height.

Every conversation is a string of turns. A prefix is named by 128 bits: the exclusive or of one pair of 64-bit hashes for each (place, turn)
in it, so that prefixes can be hashed by windows without laying a conversation into one row. Conversations
are cut every ``PIECE`` turns; a piece is a string below the prefix before it, so the trie is a forest of tries at most ``PIECE`` high.

A task keeps the compacted nodes of its tries in a hash table under their handles: the prefix whose length is the two-fattest number (the
one with most trailing zero bits) between the lengths of the parent's extent and its own. A fat binary search over these lengths finds the node where a
piece leaves the trie in a logarithm of its length; the node's edge is cut there and a leaf is hung below. Batches go in one after another,
pieces in ranges of their prefixes at doubling lengths, so that what shares a prefix meets in a task and a common first turn is
still cut further down. Edges are expanded at the end, one row per prefix with the sums of the strings below it, and rows of a prefix that stood in several
tasks are added up. A table is handed on whenever it holds ``FLUSH`` turns; since everything is a sum or a minimum, that changes nothing.

Subtree totals use that the prefixes whose smallest member is conversation c form one vertical chain. Sums run along chains; the total of a chain
belongs to all prefixes above its top, which is again a sum over the strings below a prefix, and the same tries do it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracegraph.functions.ordered import running, sequence
from tracegraph.llm.common import land, word_count

PIECE = 512  # turns of a piece, and so the height of a trie
FLUSH = 1_000_000  # turns that a task's trie holds before it is handed on
SLICE = 4096  # turns that are put in order at a time


def fattest(a: int, b: int) -> int:
    """The number in (a, b] with most trailing zero bits."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class ZFastTrie:
    """Compacted trie of key lists: ``keys[d - 1]`` names the prefix of length d. Node 0 and up; roots have length 0."""

    def __init__(self) -> None:
        self.top, self.end, self.parent, self.keys, self.words, self.base = [], [], [], [], [], []
        self.least, self.sums = [], []
        self.handles: dict[bytes, int] = {}  # two-fattest prefix to node
        self.first: dict[bytes, int] = {}  # first prefix below the parent to node
        self.roots: dict[tuple[bytes, int], int] = {}
        self.size = 0

    def _node(self, top: int, end: int, parent: int, keys: list[bytes], words: list[int], base: tuple[bytes, int]) -> int:
        for column, value in zip((self.top, self.end, self.parent, self.keys, self.words, self.base, self.least, self.sums),
                                 (top, end, parent, keys, words, base, None, [0, 0])):
            column.append(value)
        return len(self.top) - 1

    def _hang(self, node: int) -> None:
        top, end, keys = self.top[node], self.end[node], self.keys[node]
        self.handles[keys[fattest(top, end) - 1]] = node
        self.first[keys[top]] = node

    def locate(self, root: int, keys: list[bytes]) -> tuple[int, int]:
        """The exit node of a string and the length of what they share; the node's whole extent if the string goes on or ends there."""
        node, a, b, shared = root, 0, len(keys), 0
        while a < b:
            f = fattest(a, b)
            hit = self.handles.get(keys[f - 1])
            if hit is None:
                b = f - 1
                continue
            end = self.end[hit]
            if end > len(keys) or self.keys[hit][end - 1] != keys[end - 1]:
                return hit, self._shared(hit, keys, f)
            node, a, shared = hit, end, end
        while shared == self.end[node] and shared < len(keys) and (child := self.first.get(keys[shared])) is not None:
            node, shared = child, self._shared(child, keys, shared + 1)
        return node, shared

    def _shared(self, node: int, keys: list[bytes], low: int) -> int:
        """The length of the longest common prefix, ``low`` or more; names of prefixes agree up to it and differ after."""
        own, high = self.keys[node], min(self.end[node], len(keys))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if own[mid - 1] == keys[mid - 1] else (low, mid - 1)
        return low

    def insert(self, base: tuple[bytes, int], keys: list[bytes], words: list[int], least: int, sums: tuple[int, int]) -> None:
        if base not in self.roots:
            self.roots[base] = self._node(0, 0, -1, [], [], base)
        node, shared = self.locate(self.roots[base], keys)
        if shared < self.end[node]:
            node = self._cut(node, shared)
        if shared < len(keys):
            node = self._node(shared, len(keys), node, keys, words, base)
            self._hang(node)
            self.size += len(keys)
        if self.least[node] is None or least < self.least[node]:
            self.least[node] = least
        total = self.sums[node]
        total[0] += sums[0]
        total[1] += sums[1]

    def _cut(self, node: int, at: int) -> int:
        """Cut the edge to ``node`` at a length inside it; returns the new upper node."""
        del self.handles[self.keys[node][fattest(self.top[node], self.end[node]) - 1]]
        upper = self._node(self.top[node], at, self.parent[node], self.keys[node], self.words[node], self.base[node])
        self.top[node], self.parent[node] = at, upper
        self._hang(upper)
        self._hang(node)
        return upper

    def expanded(self) -> pa.RecordBatch | None:
        """One row per prefix: its name, the name before it, depth, words of its last turn, least member and sums of the strings through it."""
        for node in sorted(range(len(self.top)), key=self.end.__getitem__, reverse=True):
            up = self.parent[node]
            if up >= 0:
                if self.least[up] is None or (self.least[node] is not None and self.least[node] < self.least[up]):
                    self.least[up] = self.least[node]
                self.sums[up][0] += self.sums[node][0]
                self.sums[up][1] += self.sums[node][1]
        nodes = [k for k in range(len(self.top)) if self.end[k]]
        if not nodes:
            return None
        lengths = np.array([self.end[k] - self.top[k] for k in nodes])
        name = b"".join(b"".join(self.keys[k][self.top[k]:self.end[k]]) for k in nodes)
        before = b"".join((self.keys[k][self.top[k] - 1] if self.top[k] else self.base[k][0]) + b"".join(self.keys[k][self.top[k]:self.end[k] - 1]) for k in nodes)
        words = np.concatenate([np.array(self.words[k][self.top[k]:self.end[k]], np.int64) for k in nodes])
        depth = np.concatenate([self.base[k][1] + np.arange(self.top[k] + 1, self.end[k] + 1) for k in nodes])
        each = lambda v: np.repeat(np.array(v, np.int64), lengths)
        a, b = (np.frombuffer(x, np.int64).reshape(-1, 2) for x in (name, before))
        cols = [a[:, 0], a[:, 1], b[:, 0], b[:, 1], depth, words, each([self.least[k] for k in nodes]), each([self.sums[k][0] for k in nodes]), each([self.sums[k][1] for k in nodes])]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in cols], names=[c.split()[0] for c in PREFIX.split(", ")])


PREFIX = "ha bigint, hb bigint, pa bigint, pb bigint, depth bigint, words bigint, least bigint, one bigint, two bigint"


def _build(flush: int, piece: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for batch in batches:
            lists = batch.column("turns")
            flat, lengths = lists.flatten(), lists.value_lengths().to_numpy()
            ends = np.cumsum(lengths)
            ra, rb = (batch.column(c).to_numpy() for c in ("ra", "rb"))
            names = np.stack([flat.field(i).to_numpy() ^ np.repeat(r, lengths) for i, r in enumerate((ra, rb))], axis=1).tobytes()
            words, roots = flat.field(2).to_numpy().tolist(), np.stack([ra, rb], axis=1).tobytes()
            rows = zip(*(batch.column(c).to_pylist() for c in ("p", "least", "one", "two")))
            for k, (p, least, one, two) in enumerate(rows):
                end, start = int(ends[k]), int(ends[k] - lengths[k])
                keys = [names[16 * i:16 * i + 16] for i in range(start, end)]
                trie.insert((roots[16 * k:16 * k + 16], p * piece), keys, words[start:end], least, (one, two))
                if trie.size > flush:
                    yield trie.expanded()
                    trie = ZFastTrie()
        if (last := trie.expanded()) is not None:
            yield last

    return build


def prefix_sums(strings: DataFrame, name: str) -> DataFrame:
    """From pieces (p, ra, rb, turns, least, one, two) to one row per prefix (the columns of ``PREFIX``): minimum and sums over the strings that start with it.

    Equal pieces are combined first, so that a string that many share comes once.
    """
    last = lambda f: F.element_at("turns", -1)[f].bitwiseXOR(F.col(f"r{f}"))
    whole = strings.select("*", last("a").alias("ta"), last("b").alias("tb"), F.size("turns").alias("n"))
    combined = land(whole.groupBy("p", "n", "ta", "tb").agg(
        F.min("least").alias("least"), F.sum("one").alias("one"), F.sum("two").alias("two"),
        F.min("ra").alias("ra"), F.min("rb").alias("rb"), F.first("turns").alias("turns")), f"{name}-strings")
    levels = [F.element_at("turns", F.least(F.lit(1 << i), F.size("turns")))["a"] for i in range(PIECE.bit_length())]
    ranged = combined.select("p", "ra", "rb", "turns", "least", "one", "two").repartitionByRange("p", "ra", *levels)
    partial = ranged.mapInArrow(_build(FLUSH, PIECE), PREFIX)
    return partial.groupBy("ha", "hb").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("depth").alias("depth"), F.min("words").alias("words"),
                                           F.min("least").alias("least"), F.sum("one").alias("one"), F.sum("two").alias("two"))


def turn_codes(conversations: DataFrame) -> DataFrame:
    """Rows (c, k, code, words): the turns of every conversation, numbered from 0 by turn (null first), equal turns by code.

    Null roles and texts are empty; rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("c"), F.col("turn").cast("bigint").alias("t"), code.alias("code"), word_count(text).alias("words"))
    part = F.coalesce(F.expr(f"t div {SLICE}"), F.lit(-(1 << 60)))
    return sequence(land(rows, "turns"), ["c"], ["t", "code"], part, index="k").select("c", "k", "code", "words")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(convs, steps): every conversation c takes its first h turns from conversation c - c % ``group`` and the rest, after its first h, from
    its own; h = crc32(c) % ``heads``. ``convs`` has (c, length), ``steps`` (c, d, code, words) with d from 1."""
    turns = land(turns, "numbered-turns")
    own = land(turns.groupBy("c").agg(F.count("*").alias("own")), "conversations")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    asked = own.select("c", "own", h.alias("h"), (F.col("c") - F.col("c") % group).alias("b"))
    lent = own.select(F.col("c").alias("b"), F.col("own").alias("has"))
    asked = asked.join(lent, "b", "left").withColumn("lent", F.least("h", F.coalesce("has", F.lit(0))))
    convs = land(asked.select("c", "b", "h", "lent", (F.col("lent") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")), "rebuilt")
    rest = turns.join(convs.select("c", "h", "lent"), "c").filter("k >= h").select("c", (F.col("k") - F.col("h") + F.col("lent") + 1).alias("d"), "code", "words")
    head = turns.filter((F.col("k") < heads - 1) & (F.col("c") % group == 0)).select(F.col("c").alias("b"), "k", "code", "words")
    taken = head.join(convs.filter("h > 0").select("b", "c", "h"), "b").filter("k < h").select("c", (F.col("k") + 1).alias("d"), "code", "words")
    return convs.select("c", "length"), rest.unionByName(taken)


def pieces(steps: DataFrame) -> DataFrame:
    """Rows (c, p, ra, rb, turns): the p-th piece of conversation c, the name of the prefix before it, and for every turn of it what its prefix adds to that name."""
    p = F.expr(f"(d - 1) div {PIECE}")
    w = W.partitionBy("c", "p").orderBy("d")
    a, b = F.bit_xor(F.xxhash64("d", "code")).over(w), F.bit_xor(F.xxhash64("code", "d")).over(w)
    rows = steps.withColumn("p", p).select("c", "p", "d", a.alias("a"), b.alias("b"), "words")
    cut = land(rows.groupBy("c", "p").agg(F.array_sort(F.collect_list(F.struct("d", "a", "b", "words"))).alias("x")), "cut")  # at most PIECE turns
    cut = cut.select("c", "p", F.transform("x", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["words"].alias("words"))).alias("turns"))
    earlier = W.partitionBy("c").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    last = F.element_at("turns", -1)
    long = cut.groupBy("c").agg(F.max("p").alias("pieces")).filter("pieces > 0").select("c")
    carry = cut.select("c", "p", last["a"].alias("a"), last["b"].alias("b")).join(long, "c").select(
        "c", "p", F.bit_xor("a").over(earlier).alias("ra"), F.bit_xor("b").over(earlier).alias("rb")).filter("p > 0")
    zero = F.lit(0).cast("bigint")
    return cut.join(carry, ["c", "p"], "left").select("c", "p", F.coalesce("ra", zero).alias("ra"), F.coalesce("rb", zero).alias("rb"), "turns")


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hex SHA-256 of the comma-joined ids of each (ha, hb), rows sorted by these and id; no more than a batch is held."""
    now, digest = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["ha", "hb", "ends_sha256"])

    done: list[tuple[int, int, str]] = []
    for batch in batches:
        done = []
        for a, b, c in zip(*(batch.column(n).to_pylist() for n in ("ha", "hb", "c"))):
            if (a, b) != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (a, b), hashlib.sha256(str(c).encode())
            else:
                digest.update(f",{c}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))], names=["ha", "hb", "ends_sha256"])
    if now is not None:
        yield out()


def end_digests(convs: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows (ha, hb, ends_sha256): digest of the ids of the conversations that end at a prefix.

    A digest is taken over one stream of ids, so one task reads the ids of a prefix, in order and without holding them.
    """
    last = lambda f: F.element_at("turns", -1)[f].bitwiseXOR(F.col(f"r{f}"))
    ends = cut.groupBy("c").agg(F.max_by(F.struct(last("a").alias("ha"), last("b").alias("hb")), "p").alias("e")).select("e.ha", "e.hb", "c")
    zero = F.lit(0).cast("bigint")
    ends = ends.unionByName(convs.filter("length = 0").select(zero.alias("ha"), zero.alias("hb"), "c"))
    return ends.repartition("ha", "hb").sortWithinPartitions("ha", "hb", "c").mapInArrow(_hash_ids, "ha bigint, hb bigint, ends_sha256 string")


def conversation_trie(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """The trie of all rebuilt conversations (see ``rebuilt``), one row per prefix; other columns of the input are not read.

    Columns: prefix and parent (names, 32 hex digits; the root's parent is null), conv_id (smallest member), depth, parent_conv_id (null
    for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Repeated rows are turns of their own. Without conversations
    there is no root and no row. A conversation may be of any length: no row holds more than ``PIECE`` of its turns.
    """
    convs, steps = rebuilt(turn_codes(conversations), group, heads)
    cut = land(pieces(steps), "pieces")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    counted = prefix_sums(cut.select("p", "ra", "rb", "turns", F.col("c").alias("least"), one.alias("one"), zero.alias("two")), "members")
    root = convs.agg(F.min("c").alias("c"), F.count("*").alias("n")).filter("n > 0")
    none = F.lit(None).cast("bigint")
    nodes = land(counted.select("ha", "hb", "pa", "pb", "depth", "words", F.col("least").alias("c"), F.col("one").alias("n")).unionByName(
        root.select(zero.alias("ha"), zero.alias("hb"), none.alias("pa"), none.alias("pb"), zero.alias("depth"), zero.alias("words"), "c", "n")), "prefixes")

    kids = nodes.filter("pa IS NOT NULL").groupBy(F.col("pa").alias("ha"), F.col("pb").alias("hb")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("ha").alias("pa"), F.col("hb").alias("pb"), F.col("c").alias("parent_conv_id"))
    tree = land(nodes.join(kids, ["ha", "hb"], "left").join(above, ["pa", "pb"], "left").select(
        "ha", "hb", "pa", "pb", "depth", "c", "n", "parent_conv_id", F.coalesce("n_children", zero).alias("n_children"),
        ((F.col("n") - 1) * F.col("words")).alias("saved"), F.when(F.col("n_children").isNull(), one).otherwise(zero).alias("leaf"), (-F.col("depth")).alias("up")), "tree")

    chains = running(tree, ["c"], ["up"], F.expr(f"up div {SLICE}"), {"own_saved": "saved", "own_leaves": "leaf"})
    owners = land(tree.groupBy("c").agg(F.min("depth").alias("top"), F.sum("saved").alias("one"), F.sum("leaf").alias("two")).filter(
        "top > 0 AND (one > 0 OR two > 0)"), "chains")
    room = F.col("top") - 1 - F.col("p") * PIECE
    upper = cut.join(owners.filter("top > 1"), "c").filter(room > 0).select(
        "p", "ra", "rb", F.slice("turns", F.lit(1), F.least(room, F.size("turns")).cast("int")).alias("turns"), F.col("c").alias("least"), "one", "two")
    below = prefix_sums(upper, "chains").select("ha", "hb", "one", "two").unionByName(
        owners.agg(F.sum("one").alias("one"), F.sum("two").alias("two")).select(zero.alias("ha"), zero.alias("hb"), "one", "two"))

    name = lambda a, b: F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    total = lambda x, y: (F.col(x) + F.coalesce(F.col(y), zero)).cast("bigint")
    out = chains.join(below, ["ha", "hb"], "left").join(end_digests(convs, cut), ["ha", "hb"], "left")
    return out.select(
        name("ha", "hb").alias("prefix"), F.when(F.col("pa").isNotNull(), name("pa", "pb")).alias("parent"), F.col("c").alias("conv_id"), "depth", "parent_conv_id",
        F.col("n").alias("n_convs"), "n_children", total("own_leaves", "two").alias("n_leaves"), total("own_saved", "one").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
