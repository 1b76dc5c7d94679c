"""Mixing sources to target weights by Sainte-Lague apportionment of equal word blocks.

1. Targets: the budget is shared by weight; no source gets more than ``most`` times its own
   words, and what is left over is shared again by weight (water filling, in closed form
   over one row per source).
2. Quotas: the budget in blocks of ``block_words`` goes to sources by highest quotients
   target / (2 j + 1), then from source to its shards and from shard to its cells by the same
   rule. Cells are small seeded groups of documents, shards are runs of cells, so each
   apportionment ranks a bounded number of rows even for a source with most documents.
3. Selection: the documents of a cell stand in seeded order; their words form one stream cut into blocks.
   A quota of ``q`` over ``n`` blocks takes every block ``q div n`` times and ``q mod n`` more blocks, those
   from a seeded start on, around the end of the stream. Nearly all documents are so
   taken a whole number of times; only those at the two ends of a run are cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tracegraph.llm.common import WORD, asked, bitmaps, delete, fresh, hash60, land, noting, word_count

CELL_DOCS = 512  # documents in a cell, on average
SHARD_CELLS = 256  # cells in a shard


def source_targets(sized: DataFrame, weights: Sequence[float], factor: float, most: float) -> DataFrame:
    """One row per source of ``sized`` (source, key, size): key, source_size, docs, target."""
    src = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = src.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                        ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
    fill = W.orderBy(F.col("source_size") / F.col("weight"), "nth")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    budget = F.sum("source_size").over(W.partitionBy()) * factor
    rest = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighted.withColumn("level", (budget - capped) / rest)
    # the water level rises while sources overflow and falls after, so the largest one is the last that holds
    return level.withColumn("level", F.max("level").over(W.partitionBy())).select(
        "key", "source_size", "docs", F.least(F.col("source_size") * most, F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(parts: DataFrame, value: str, seats: str, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Hand out ``seats`` (equal within a group of ``by``) to the rows of the group by highest quotients value / (2 j + 1).

    Adds ``quota``. Seats that every row surely holds are given at once; only the few
    quotients around the last seat (about four a row) are ranked. ``tie`` orders equal quotients.
    A group whose values are all zero gets no seats.
    """
    group = W.partitionBy(*by)
    total, rows = F.sum(value).over(group), F.count("*").over(group)
    share = F.when(F.col("_total") > 0, F.col(value) * F.col(seats) / F.col("_total")).otherwise(0.0)
    slack = F.when(F.col("_total") > 0, F.col(value) * F.col("_rows") / (2 * F.col("_total"))).otherwise(0.0)
    cols = parts.columns
    ready = (
        parts.withColumns({"_total": total.cast("double"), "_rows": rows})
        .withColumns({"_low": F.greatest(F.lit(0), F.floor(share - slack) - 1).cast("bigint"),
                      "_high": (F.ceil(share + slack) + 1).cast("bigint")})
        .withColumn("_left", F.when(F.col("_total") > 0, F.col(seats)).otherwise(0) - F.sum("_low").over(group))
    )
    asked = ready.withColumn("_seat", F.explode(F.sequence("_low", "_high")))
    rank = F.row_number().over(group.orderBy((F.col(value) / (2 * F.col("_seat") + 1)).desc(), *tie, "_seat"))
    won = asked.withColumn("_won", (rank <= F.col("_left")).cast("bigint"))
    return won.groupBy(*cols).agg((F.first("_low") + F.sum("_won")).alias("quota"))


def _overlap(a: Column, b: Column, start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, end) - F.greatest(a, start)).cast("bigint")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), factor: float = 1.5, most: int = 2, block_words: int = 16,
        seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """Decide for every document how many of its words the mix takes.

    Returns doc_id, the columns of ``carry``, size, source_size, target, taken, copies (whole copies
    taken) and cuts: up to two word ranges ``[from, to)`` of one more, partial copy.

    A null text has size 0 and is taken 0 times. A null source is a source of its own and comes last.
    Sources without words get target 0. Rows that repeat are documents of their own; rows without id
    are placed by their text. An empty table gives no rows. Reruns agree, whatever the partitioning.
    A carried column keeps its name, and a column of the result that is called so gets a longer one.
    """
    named = lambda c: fresh(carry, c)
    text, source = F.col("text"), F.col("source").cast("string")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    sized = land(docs.select(
        "doc_id", F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("row"),
        source.alias("source"), F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("key"),
        word_count(text).alias("size"), hash60(F.lit(str(seed)), ident).alias("h"), F.xxhash64(text).alias("t")), "mix-sizes")

    sources = source_targets(sized.select("source", "key", "size"), weights, factor, most)
    quotas = sainte_lague(
        sources.withColumn("seats", F.round(F.sum("target").over(W.partitionBy()) / block_words).cast("bigint")),
        "target", "seats", [], ["key"]).withColumnRenamed("quota", "source_quota")
    cells_of = F.greatest(F.lit(1), F.ceil(F.col("docs") / CELL_DOCS)).cast("bigint")
    placed = sized.join(quotas.select("key", "source_size", "target", "docs", "source_quota"), "key").withColumn("cell", F.col("h") % cells_of)
    # one column names the cell, so that a partitioning by source alone does not do for what follows
    placed = placed.withColumn("stream", F.concat_ws(" ", "cell", "key"))

    cells = placed.groupBy("stream").agg(F.first("key").alias("key"), F.first("cell").alias("cell"), F.sum("size").alias("words"),
                                         F.first("source_quota").alias("source_quota"))
    cells = cells.withColumn("shard", F.floor(F.col("cell") / SHARD_CELLS))
    shards = cells.groupBy("key", "shard").agg(F.sum("words").alias("shard_words"), F.first("source_quota").alias("source_quota"))
    shards = sainte_lague(shards, "shard_words", "source_quota", ["key"], ["shard"]).select(
        "key", "shard", F.col("quota").alias("shard_quota"))
    cells = sainte_lague(cells.drop("source_quota").join(shards, ["key", "shard"]), "words", "shard_quota", ["key", "shard"], ["cell"])
    cells = cells.withColumn("blocks", F.ceil(F.col("words") / block_words)).withColumn(
        "quota", F.least("quota", most * F.col("blocks"))).select(
        "stream", "words", "blocks",
        F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).alias("copies"),
        F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0).alias("extra"),
        F.when(F.col("blocks") > 0, hash60(F.lit(f"{seed} start"), F.col("key"), F.col("cell").cast("string")) % F.col("blocks")).otherwise(0).alias("start"))

    placed = placed.drop("key", "cell")
    stream = W.partitionBy("stream").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", "t")
    to = F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0))
    x = placed.withColumn("to", to).join(cells, "stream").withColumn("from", F.col("to") - F.col("size"))
    end = F.col("start") + F.col("extra")
    x = x.withColumns({"a1": F.col("start") * block_words, "b1": F.least(F.least(end, F.col("blocks")) * block_words, F.col("words")),
                       "b2": F.greatest(F.lit(0), end - F.col("blocks")) * block_words})
    x = x.withColumns({"o1": _overlap(F.col("a1"), F.col("b1"), F.col("from"), F.col("to")),
                       "o2": _overlap(F.lit(0), F.col("b2"), F.col("from"), F.col("to"))})
    cut = lambda a, b: F.struct((F.greatest(a, F.col("from")) - F.col("from")).cast("bigint").alias("from"),
                                (F.least(b, F.col("to")) - F.col("from")).cast("bigint").alias("to"))
    cuts = F.filter(F.array(cut(F.lit(0), F.col("b2")), cut(F.col("a1"), F.col("b1"))), lambda c: c["to"] > c["from"])
    own = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.round("target", 6),
           "taken": (F.col("copies") * F.col("size") + F.col("o1") + F.col("o2")).cast("bigint"), "copies": F.col("copies").cast("bigint"), "cuts": cuts}
    return x.select(F.col("doc_id").alias(named("doc_id")), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)], *[v.alias(named(c)) for c, v in own.items()])


def _cut(text: str, ranges: list[dict], word) -> str:
    """The words of the ranges with what stands between them; a range to 0 ends with the last word."""
    ends = [(m.start(), m.end()) for m in word.finditer(text)]
    return "\n".join(text[ends[r["from"]][0]:ends[r["to"] - 1][1]] for r in ranges)


def mixed(docs: DataFrame, most: int = 2, **how) -> DataFrame:
    """The mix itself: each document of ``docs`` as often as ``mix`` takes it, a partial copy cut to its words; n_chars, where there is one, follows the text.

    All columns are kept, whatever their names. Null and empty texts are never taken. An empty table gives no rows.
    Copies reach the texts as bitmaps; only cuts inside a document, at most three in a cell, go as rows.
    """
    columns, schema = docs.columns, docs.schema
    rows = land(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")), "rows")
    steps: list[str] = []
    with noting(steps):
        taken = mix(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), carry=["row"], most=most, **how).filter("taken > 0")
        only = F.get("cuts", 0)
        all_words = (F.size("cuts") == 1) & (only["from"] == 0) & (only["to"] == F.col("size"))
        copies = land(taken.select("row", "copies", "cuts", F.coalesce(all_words, F.lit(False)).alias("whole")), "copies")
    bits = land(bitmaps(copies, "row", whole=F.col("whole"), **{f"copy{k}": F.col("copies") >= k for k in range(1, most + 1)}), "copies")
    parts = land(copies.filter("size(cuts) > 0 AND NOT whole").select(F.col("row").alias("cut_row"), "cuts"), "cuts")
    delete(docs.sparkSession, steps)
    kind = parts.schema["cuts"].dataType
    none, whole = F.array().cast(kind), F.array(F.struct(F.lit(0).alias("from"), F.lit(0).alias("to"))).cast(kind)
    one = lambda on, ranges: F.when(on, F.array(ranges)).otherwise(F.array().cast(T.ArrayType(kind)))
    each = F.concat(*[one(F.col(f"copy{k}"), none) for k in range(1, most + 1)], one(F.col("whole"), whole), one(F.col("cuts").isNotNull(), F.col("cuts")))
    cuts = fresh(columns, "_cuts")
    text, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else -1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for batch in batches:
            cols = list(batch.columns[:len(columns)])
            ranges = batch.column(len(columns)).to_pylist()
            if any(ranges):
                texts = [_cut(t, c, word) if c else t for t, c in zip(cols[text].to_pylist(), ranges)]
                cols[text] = pa.array(texts, cols[text].type)
                if chars >= 0:
                    own = cols[chars].to_pylist()
                    cols[chars] = pa.array([len(t) if c else n for t, c, n in zip(texts, ranges, own)], cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    met = asked(rows, "row", bits).join(F.broadcast(parts), F.col("row") == F.col("cut_row"), "left")
    return met.select("doc.*", F.explode(each).alias(cuts)).mapInArrow(cut, schema)
