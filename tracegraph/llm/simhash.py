"""SimHash near-duplicates by anchor-point covering.

A fingerprint of 64 bits is cut into three segments; two fingerprints at ``THRESHOLD`` = 4 or fewer differing bits
differ by at most one bit in some segment. The anchors of a segment are the words of a covering
code: a (15, 11) Hamming code on its first 15 bits, all words on the rest. Its covering radius is one, so a
fingerprint has one home anchor within one bit; it is copied to every anchor within radius plus
one bit (15 or so). Whatever lies within one bit of a fingerprint is then a visitor of its home anchor, and
only homes and visitors of one anchor are compared, by all 64 bits.

Equal fingerprints meet before that in an aggregate, and a task turns the links it finds into the
edges of a forest, so a group of near copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracegraph.llm.common import asked, bitmaps, delete, fresh, land, noting
from tracegraph.llm.components import components

SHINGLE, SEED, THRESHOLD = 4, 42, 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
HAMMING = 15
HOME_LIMIT = 4096  # homes of an anchor that one task compares at a time; more are dealt out in blocks
PAIRS = 1 << 21  # comparisons made at a time


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of the lower-cased 4-word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1:] if len(words) >= SHINGLE else ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k:k + (1 << 15)].tolist(), last[k:k + (1 << 15)].tolist())], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with ``fp``, the signed fingerprint; a column named fp gives way. Null is like empty."""
    rest = [c for c in docs.columns if c != text and c.lower() != "fp"]
    schema = docs.select(*[f"`{c}`" for c in rest], F.lit(0).cast("bigint").alias("fp")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(t.as_py()) for t in batch.column(text)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [fp], names=rest + ["fp"])

    return docs.select(*[f"`{c}`" for c in [*rest, text]]).mapInArrow(add, schema)


# ---------------------------------------------------------------- anchors

def _syndromes() -> np.ndarray:
    x = np.arange(1 << HAMMING, dtype=np.int64)
    s = np.zeros_like(x)
    for i in range(HAMMING):
        s ^= np.where(x >> i & 1, i + 1, 0)
    return s


SYNDROME = _syndromes()  # 0 for code words, else one plus the place of the bit that leads to one


def _flips(free: int) -> list[np.ndarray]:
    """By syndrome: the bit changes of at most two bits that lead to an anchor; the first one leads home."""
    bit = lambda s: 1 << (s - 1)
    high = [1 << (HAMMING + j) for j in range(free)]
    out = [np.array([0, *high, *[a | b for i, a in enumerate(high) for b in high[:i]]], dtype=np.int64)]
    for s in range(1, HAMMING + 1):
        pairs = [bit(i) | bit(i ^ s) for i in range(1, HAMMING + 1) if i < i ^ s <= HAMMING]
        out.append(np.array([bit(s), *[bit(s) | h for h in high], *pairs], dtype=np.int64))
    return out


FLIPS = [_flips(bits - HAMMING) for _, bits in SEGMENTS]


def anchor_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, fingerprint and whether the anchor is home, for every anchor that a fingerprint is copied to."""
    anchors, copies, homes = [], [], []
    u = fps.view(np.uint64)
    for k, (first, bits) in enumerate(SEGMENTS):
        seg = (u >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syn = SYNDROME[seg & ((1 << HAMMING) - 1)]
        for s in range(HAMMING + 1):
            at = np.flatnonzero(syn == s)
            if len(at):
                flips = FLIPS[k][s]
                anchors.append(((seg[at][:, None] ^ flips[None, :]) * len(SEGMENTS) + k).ravel())
                copies.append(np.repeat(fps[at], len(flips)))
                homes.append(np.tile(np.arange(len(flips)) == 0, len(at)))
    if not anchors:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(anchors), np.concatenate(copies), np.concatenate(homes)


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), 1 << 15):
            a, f, h = anchor_rows(batch["fp"].to_numpy()[k:k + (1 << 15)])
            yield pd.DataFrame({"anchor": a, "fp": f, "home": h})


# ---------------------------------------------------------------- comparison

def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for every component of the links: each node but the least with the least one."""
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ix[:len(a)], ix[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new[new]]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _near(homes: np.ndarray, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    close = np.bitwise_count(homes.view(np.uint64) ^ visitors.view(np.uint64)) <= THRESHOLD
    close &= homes != visitors
    return homes[close], visitors[close]


def _links_of(homes: np.ndarray, at: np.ndarray, visitors: np.ndarray, va: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes (sorted by anchor ``at``) and visitors with the same anchor ``va``, as a forest."""
    first, last = np.searchsorted(at, va, "left"), np.searchsorted(at, va, "right")
    n = last - first
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    done = np.concatenate([[0], np.cumsum(n)])
    k = 0
    while k < len(va):
        stop = max(k + 1, int(np.searchsorted(done, done[k] + PAIRS, "right")) - 1)
        m = n[k:stop]
        total = int(m.sum())
        if total:
            place = np.arange(total) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[k:stop], m)
            a, b = _near(homes[place], np.repeat(visitors[k:stop], m))
            if len(a):
                a, b = forest(a, b)
                out_a.append(a)
                out_b.append(b)
        k = stop
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return forest(a, b) if len(out_a) > 2 else (a, b)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by slot (anchor, block, visitors after homes); the homes of the last slot stay for the next batch."""
    homes, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        slot, fp = batch["slot"].to_numpy(), batch["fp"].to_numpy()
        if not len(slot):
            continue
        group, home = slot >> 1, (slot & 1) == 0
        homes, at = np.concatenate([homes, fp[home]]), np.concatenate([at, group[home]])
        a, b = _links_of(homes, at, fp, group)
        keep = at == group[-1]
        homes, at = homes[keep], at[keep]
        if len(a):
            yield pd.DataFrame({"a": a, "b": b})


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between the different fingerprints of ``fps`` (fp) that make all components of the relation."""
    rows = fps.select("fp").mapInPandas(_anchors, "anchor bigint, fp bigint, home boolean")
    heavy = rows.filter("home").groupBy("anchor").agg(F.count("*").alias("homes")).filter(F.col("homes") > HOME_LIMIT)
    rows = rows.join(heavy, "anchor", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("homes") / HOME_LIMIT), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a home is in one block of its anchor and a visitor in all; a home visits the other blocks as well
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.col("anchor") * (1 << 20) + F.col("block")
    rows = rows.select(group.alias("g"), (group * 2 + F.when(F.col("home") & (F.col("block") == own), 0).otherwise(1)).alias("slot"), "fp")
    return rows.repartition("g").sortWithinPartitions("slot").select("slot", "fp").mapInPandas(_compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, fp (signed) and component, the least key reachable over links.

    Texts without words have fingerprint 0 and are linked like any other. Null keys are never the least
    while the component has another; repeated rows are in one component. An empty table gives no rows.
    """
    prints = land(fingerprints(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))), "fingerprints")
    return with_components(prints).withColumnRenamed("key", key)


def with_components(prints: DataFrame) -> DataFrame:
    """Add ``component`` to a landed table with key and fp."""
    distinct = land(prints.groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    roots = components(near_links(distinct))
    # the nodes of a component, its root too, meet in one partial minimum
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = land(named.groupBy("root").agg(F.min("least").alias("component")), "components")
    by_fp = land(named.join(least, "root").select("fp", "component"), "components")
    return prints.join(by_fp, "fp").select(*[c for c in prints.columns if c != "fp"], "fp", "component")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the least key (null last), of repeated keys the first row."""
    row = fresh(docs.columns, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    order = F.struct(F.col(f"`{key}`").isNull().alias("n"), F.col(f"`{key}`").alias("k"), F.col(row).alias("r"))
    landed = land(numbered, "rows")
    steps: list[str] = []
    with noting(steps):
        prints = land(fingerprints(landed.select(order.alias("key"), F.col(f"`{text}`").alias("text"))), "fingerprints")
        kept = with_components(prints).filter("key = component").select(F.col("component.r").alias(row))
    mark = fresh(landed.columns, "_kept")
    bits = land(bitmaps(kept, row, **{mark: F.lit(True)}), "kept")
    delete(docs.sparkSession, steps)
    return asked(landed, row, bits).filter(F.col(mark)).drop(row, mark)
