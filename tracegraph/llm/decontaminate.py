"""Benchmark decontamination over a positional inverted index of the training tokens.

The index has a posting list (sorted places) for every term and document. Terms that no test item
has are left out by a bitmap of fixed size, and so are places that no window can cover: those outside
runs of ``run`` neighbouring test terms. ``run`` = 1 keeps every place of a test term.

Search starts from the rarest term of each window (counted in the index): its places, moved by the term's
offset, give the places where an item may lie in a document. There the lists of all other terms of
the item, moved likewise, are intersected by a join; unbroken stretches of a window's length are matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tracegraph.llm.common import delete, land, noting

WINDOW = 13
BITS = 23  # the bitmap of test terms has 2^BITS places: one MB however many items there are
TOKENS = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words of digits, letters a to z (A-Z lower-cased) and everything beyond ASCII."""
    return (text or "").encode("utf-8").lower().translate(TOKENS).split()


def term_id(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class _Terms(dict):
    """Ids of words, 0 for words outside the bitmap; forgets all when it has grown large."""

    def __init__(self, bitmap: np.ndarray):
        super().__init__()
        self.bitmap = bitmap

    def __missing__(self, word: bytes) -> int:
        t = term_id(word) or 1
        place = t & ((1 << BITS) - 1)
        if not self.bitmap[place >> 3] >> (place & 7) & 1:
            t = 0
        if len(self) > 500_000:
            self.clear()
        self[word] = t
        return t


# ---------------------------------------------------------------- test items

def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """One row per word of an item: item (row number), id (the key as text, '' for null), k, term, n (words of the item)."""
    schema = "item bigint, id string, k int, term bigint, n int"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, d, k, term_id(w) or 1, len(ws)) for i, d, t in zip(*(batch.column(c).to_pylist() for c in range(3)))
                    for ws in [tokens(t)] for k, w in enumerate(ws)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32()))],
                                             names=["item", "id", "k", "term", "n"])

    return land(items.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"),
                             F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(split, schema), "test-terms")


def _bitmap(words: DataFrame) -> np.ndarray:
    """Places of all terms, at most 2^BITS numbers whatever the number of items."""
    places = words.select(F.col("term").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("p")).distinct().toPandas()["p"].to_numpy()
    bits = np.zeros(1 << BITS, dtype=np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little")


# ---------------------------------------------------------------- index

def build_index(spark: SparkSession, docs: DataFrame, words: DataFrame, run: int = 1, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Index ``docs`` (row, text) for the terms of ``words``: postings (term, row, places) and documents (row, n_words)."""
    bitmap = spark.sparkContext.broadcast(_bitmap(words))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(bitmap.value)
        for batch in batches:
            rows, terms, places, counts = [], [], [], []
            for row, t in zip(batch.column("row").to_pylist(), batch.column("text")):
                ws = tokens(t.as_py())
                rows.append(row)
                terms.append(None)
                places.append(None)
                counts.append(len(ws))
                ids = np.fromiter(map(known.__getitem__, ws), dtype=np.int64, count=len(ws))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids != 0).view(np.int8), [0]])))
                long = edge[1::2] - edge[::2] >= run
                at = np.concatenate([np.zeros(0, np.int64), *[np.arange(a, b) for a, b in zip(edge[::2][long], edge[1::2][long])]])
                if not len(at):
                    continue
                order = np.argsort(ids[at], kind="stable")
                kept = ids[at][order]
                cut = np.flatnonzero(np.diff(kept)) + 1
                parts = np.split(at[order], cut)
                rows += [row] * len(parts)
                terms += kept[np.concatenate([[0], cut])].tolist()
                places += parts
                counts += [None] * len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(terms, pa.int64()), pa.array(places, pa.list_(pa.int32())),
                                              pa.array(counts, pa.int64())], names=["row", "term", "places", "n_words"])

    rows = docs.select("row", F.col(f"`{text}`").cast("string").alias("text"))
    both = land(rows.mapInArrow(index, "row bigint, term bigint, places array<int>, n_words bigint"), "postings")
    return both.filter("term IS NOT NULL").select("term", "row", "places"), both.filter("term IS NULL").select("row", "n_words")


# ---------------------------------------------------------------- search

def _with_counts(words: DataFrame, postings: DataFrame) -> DataFrame:
    """Add the number of places of each term in the index; terms without any go."""
    counts = postings.groupBy("term").agg(F.sum(F.size("places")).alias("places_in_all"))
    return words.join(counts, "term")


def phrase_matches(postings: DataFrame, words: DataFrame, window: int = WINDOW) -> DataFrame:
    """All occurrences of the windows of ``words``: item, row, start, end (words, end exclusive).

    A window is ``window`` neighbouring words of an item, or the whole of a shorter item. Neighbouring
    windows that occur together come as one stretch.
    """
    size = F.least("n", F.lit(window))
    counted = land(_with_counts(words, postings), "test-terms")
    first, last = F.greatest(F.lit(0), F.col("k") - size + 1), F.least(F.col("k"), F.col("n") - size)
    windows = counted.withColumn("w", F.explode(F.sequence(first, last)))
    seeds = (windows.groupBy("item", "w").agg(F.min(F.struct("places_in_all", "k", "term")).alias("rarest"), F.count("*").alias("m"), F.first(size).alias("size"))
             .filter("m = size").select("item", "rarest.k", "rarest.term").distinct())
    found = postings.join(seeds, "term").withColumn("place", F.explode("places")).select(
        "item", "row", (F.col("place") - F.col("k")).alias("shift")).distinct()
    found = land(found, "candidates")
    expected = found.join(counted.select("item", "k", "term", "n"), "item").withColumn("place", F.col("shift") + F.col("k"))
    there = postings.join(found.select("row").distinct(), "row", "left_semi").select("row", "term", F.explode("places").alias("place"))
    matched = expected.join(there, ["row", "term", "place"])
    line = W.partitionBy("item", "row", "shift").orderBy("k")
    stretch = matched.withColumn("g", F.col("k") - F.row_number().over(line)).groupBy("item", "row", "shift", "g").agg(
        F.min("k").alias("from"), F.count("*").alias("m"), F.first(size).alias("size")).filter("m >= size")
    return stretch.select("item", "row", (F.col("shift") + F.col("from")).alias("start"), (F.col("shift") + F.col("from") + F.col("m")).cast("int").alias("end"))


def proximity_matches(postings: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """Places where all different terms of an item stand, in any order, within ``width`` words: item, row, start, end.

    Needs an index with ``run`` = 1. Starts from the item's rarest term and looks at the lists of its other
    terms in the same and the neighbouring stretch of ``width`` words only.
    """
    counted = land(_with_counts(words.select("item", "term").distinct(), postings), "test-terms")
    asked = words.groupBy("item").agg(F.countDistinct("term").alias("asked"))
    seed = counted.groupBy("item").agg(F.min(F.struct("places_in_all", "term")).alias("r"), F.count("*").alias("have")).join(asked, "item").filter("have = asked")
    hit = lambda t: postings.join(t, "term").select("item", "row", "term", F.explode("places").alias("p"), *[c for c in t.columns if c == "asked"])
    seeds = hit(seed.select("item", F.col("r.term").alias("term"), "asked")).select("item", "row", "asked", F.col("p").alias("s"))
    seeds = seeds.withColumn("cell", F.explode(F.array(*[F.floor(F.col("s") / width) + d for d in (-1, 0, 1)])))
    others = hit(counted.select("item", "term")).withColumn("cell", F.floor(F.col("p") / width))
    near = land(seeds.join(others, ["item", "row", "cell"]).filter(F.abs(F.col("p") - F.col("s")) < width).drop("cell"), "near")
    left = near.filter("p <= s").select("item", "row", "s", F.col("p").alias("start")).distinct()
    spans = left.join(near, ["item", "row", "s"]).filter((F.col("p") >= F.col("start")) & (F.col("p") < F.col("start") + width))
    ends = spans.groupBy("item", "row", "s", "start", "asked", "term").agg(F.min("p").alias("p"))
    return (ends.groupBy("item", "row", "s", "start", "asked").agg(F.count("*").alias("have"), F.max("p").alias("last")).filter("have = asked")
            .select("item", "row", "start", (F.greatest("last", "s") + 1).alias("end")).distinct())


# ---------------------------------------------------------------- documents

def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """For ``docs`` (row, text): row, n_words, n_hit, n_items, items (ids as text, sorted), contaminated.

    A word is hit inside any occurrence of a window; a document is contaminated if ``share`` times its hits reach its words.
    Null or empty texts have no words and are clean; items without words have no windows; items that repeat an id count
    once, null ids are one item ''. Without items every document is clean. Terms meet as 64-bit codes.
    """
    words = item_terms(items)
    run = words.agg(F.min(F.least("n", F.lit(window)))).first()[0] or window
    postings, counted = build_index(spark, docs, words, run)
    matches = land(phrase_matches(postings, words, window), "matches")
    line = W.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    fresh_words = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))))
    hits = matches.select("row", "start", "end").distinct().withColumn("new", fresh_words).groupBy("row").agg(F.sum("new").alias("n_hit"))
    ids = matches.select("item", "row").distinct().join(words.select("item", "id").distinct(), "item")
    ids = ids.groupBy("row").agg(F.array_sort(F.collect_set("id")).alias("items"))
    none = F.array().cast("array<string>")
    return counted.join(hits, "row", "left").join(ids, "row", "left").select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("items", none).alias("items"),
        F.coalesce((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")), F.lit(False)).alias("contaminated"))


def numbered(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` as a struct ``doc`` beside ``row``, laid down so that the numbers stay, and the text."""
    return land(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc")), "rows")


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept."""
    rows = numbered(docs, docs.columns)
    steps: list[str] = []
    with noting(steps):
        bad = contamination(spark, rows.select("row", "doc.text"), items, window, share).filter("contaminated").select("row")
    bad = land(bad, "contaminated")
    delete(spark, steps)
    return rows.join(bad, "row", "left_anti").select("doc.*")
