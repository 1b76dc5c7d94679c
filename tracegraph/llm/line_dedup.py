"""Line de-duplication by pairwise alignment.

Every line that stands in several documents points to the earliest document that holds it, and so does
every shortest run of neighbouring lines with enough words; a document is paired with each document that
its lines and runs point to. So the pairs grow with the shared lines, never with the square of a group,
and whatever block stands in any earlier document, a pair holds each of its lines in a run of enough words.
The two documents of a pair are aligned by patience diff over their shared lines, and aligned blocks of
enough words go from the later one, with the runs that the alignment leaves over.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tracegraph.llm.common import WORD, fresh, land

MIN_WORDS = 20  # a block of fewer words stays: headings, short formulas


# ---------------------------------------------------------------- alignment

def _rising(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs`` (sorted by the first number) whose second numbers rise."""
    tails, at, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        tails[p:p + 1] = [j]
        at[p:p + 1] = [k]
        back.append(at[p - 1] if p else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _anchors(a: Sequence, b: Sequence, nth: bool) -> list[tuple[int, int]]:
    """Equal items that occur once in both; with ``nth``, the n-th occurrences of equal items."""
    if nth:
        def count(seq):
            seen = Counter()
            out = {}
            for k, x in enumerate(seq):
                out[x, seen[x]] = k
                seen[x] += 1
            return out
        x, y = count(a), count(b)
    else:
        once = lambda s: {v for v, n in Counter(s).items() if n == 1}
        both = once(a) & once(b)
        x, y = ({v: k for k, v in enumerate(s) if v in both} for s in (a, b))
    return _rising(sorted((k, y[v]) for v, k in x.items() if v in y))


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned places of equal items: lines that are unique in both first, the rest in the gaps between them."""
    fixed = [(-1, -1), *_anchors(a, b, False), (len(a), len(b))]
    out = []
    for (i, j), (k, m) in zip(fixed, fixed[1:]):
        out += [(i + 1 + p, j + 1 + q) for p, q in _anchors(a[i + 1:k], b[j + 1:m], True)]
        out.append((k, m))
    return out[:-1]


def shortest_runs(body: Sequence[tuple], min_words: int) -> set[tuple[int, int]]:
    """Runs of neighbouring lines, as (begin, end) into ``body``, that reach ``min_words`` and would not without their first or without their last line.

    Every line of a block of ``min_words`` lies in such a run inside the block: in the shortest from the block's first line on, or else in
    the shortest that ends with the line.
    """
    out, begin, words = set(), 0, 0
    for end, (place, _, n) in enumerate(body):  # the shortest run that ends here
        if end and place != body[end - 1][0] + 1:
            begin, words = end, 0
        words += n
        while begin < end and words - body[begin][2] >= min_words:
            words -= body[begin][2]
            begin += 1
        if words >= min_words:
            out.add((begin, end + 1))
    end, words = len(body), 0
    for begin in range(len(body) - 1, -1, -1):  # the shortest run that begins here
        if begin + 1 < len(body) and body[begin][0] + 1 != body[begin + 1][0]:
            end, words = begin + 1, 0
        words += body[begin][2]
        while end > begin + 1 and words - body[end - 1][2] >= min_words:
            end -= 1
            words -= body[end][2]
        if words >= min_words:
            out.add((begin, end))
    return out


def common_blocks(later: Sequence[tuple], earlier: Sequence[tuple], min_words: int = MIN_WORDS) -> set[int]:
    """Lines of ``later`` in aligned blocks of ``min_words`` words or more; both are lists of (place, code, words).

    A block is a run of lines that are neighbours in both. Once deleted, the rest is aligned again, so that
    blocks that stand in another order are found too. Where the alignment ends with lines left, runs that it passed
    over (for a longer chain of small blocks, or with lines of a block that is gone) go as well.
    """
    gone: set[int] = set()
    shared = {c for _, c, _ in earlier}
    rest, b = [x for x in later if x[1] in shared], list(earlier)
    while rest:
        matched = patience([c for _, c, _ in rest], [c for _, c, _ in b])
        blocks: list[list[int]] = []
        last = None
        for i, j in matched:
            place = (rest[i][0], b[j][0])
            if last and place == (last[0] + 1, last[1] + 1):
                blocks[-1].append(i)
            else:
                blocks.append([i])
            last = place
        found = {rest[i][0] for block in blocks if sum(rest[i][2] for i in block) >= min_words for i in block}
        if not found:
            codes = lambda body, run: tuple(c for _, c, _ in body[slice(*run)])
            there = {codes(b, run) for run in shortest_runs(b, min_words)}
            return gone | {later[k][0] for run in shortest_runs(later, min_words) if codes(later, run) in there for k in range(*run)}
        gone |= found
        rest = [x for x in rest if x[0] not in found]
    return gone


# ---------------------------------------------------------------- tables

def _lines(rows: DataFrame) -> DataFrame:
    """(row, key, at, place, code, words) for the lines with words: ``at`` counts all lines, ``place`` those with words."""
    filled = F.filter(F.transform(F.split("text", "\n"), lambda v, i: F.struct(i.alias("at"), F.xxhash64(F.rtrim(v)).alias("code"),
                                                                             F.regexp_count(v, F.lit(WORD)).alias("words"))), lambda s: s["words"] > 0)
    return rows.select("row", "key", F.posexplode(filled).alias("place", "l")).select("row", "key", "l.at", "place", "l.code", "l.words")


def _align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, gone = [], []
            for row, later, earlier in zip(batch.column("row").to_pylist(), batch.column("later"), batch.column("earlier")):
                triples = [[(x["place"], x["code"], x["words"]) for x in s.as_py()] for s in (later, earlier)]
                found = common_blocks(*triples, min_words)
                if found:
                    rows.append(row)
                    gone.append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["row", "places"])

    return run


def _run_codes(min_words: int):
    """From (row, key, body) to (row, key, run), a code for each shortest run of several lines; a run of one line is the line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, codes = [], []
            for k, body in enumerate(batch.column("body")):
                triples = [(x["place"], x["code"], x["words"]) for x in body.as_py()]
                new = {_code(c for _, c, _ in triples[i:j]) for i, j in shortest_runs(triples, min_words) if j - i > 1}
                codes += new
                at += [k] * len(new)
            taken = batch.select(["row", "key"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(codes, pa.binary())], names=["row", "key", "run"])

    return run


def _code(codes: Iterable[int]) -> bytes:
    return blake2b(np.fromiter(codes, np.int64).tobytes(), digest_size=16).digest()


def repeated_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """For ``rows`` (row, key, text), where a smaller key is earlier (null last, then the row number): (row, n_lines) and (row, at) of the lines to delete."""
    lines = land(_lines(rows), "lines")
    earliest = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    holders = lambda held, c: held.groupBy(c).agg(earliest.alias("e"), F.min("row").alias("low"), F.max("row").alias("high")).filter(
        "low <> high").select(c, F.col("e.row").alias("first"))
    first = land(holders(lines, "code"), "first-holders")
    shared = land(lines.drop("at").join(first, "code"), "shared-lines")
    # a document is one row here; its shared lines are at most its own lines
    bodies = land(shared.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "code", "words"))).alias("body"), F.sum("words").alias("w"), F.min("key").alias("key"))
                  .filter(F.col("w") >= min_words).select("row", "key", "body"), "shared-bodies")
    runs = land(bodies.mapInArrow(_run_codes(min_words), T.StructType([*bodies.select("row", "key").schema.fields, T.StructField("run", T.BinaryType())])), "runs")
    pairs = shared.select("row", "first").unionByName(runs.join(land(holders(runs, "run"), "first-runs"), "run").select("row", "first")).filter(
        "first <> row").distinct()
    bodies = bodies.drop("key")
    later = land(pairs.join(bodies, "row").select("row", "first", F.col("body").alias("later")), "pairs")
    both = later.join(bodies.select(F.col("row").alias("first"), F.col("body").alias("earlier")), "first").select("row", "later", "earlier")
    found = both.mapInArrow(_align(min_words), "row bigint, places array<int>").select("row", F.explode("places").alias("place")).distinct()
    return lines.groupBy("row").agg(F.count("*").alias("n_lines")), found.join(lines, ["row", "place"]).select("row", "at", "words")


def numbered_rows(docs: DataFrame, key: str, text: str, carry: Sequence[str]) -> DataFrame:
    """(row, key, text, doc), laid down so that the row numbers stay."""
    return land(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"),
        F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("doc")), "rows")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` cleaned, and n_lines (with words), n_removed, removed_words and removed (line numbers from 0).

    The earlier document is the one with the smaller key (null last; equal keys as they come). Lines count as equal up to white space at their end; the first holder keeps
    them. Null stays null and has no lines; a repeated row loses all but blocks under ``min_words``; an empty table stays empty.
    Taken column names are lengthened.
    """
    names = [fresh(docs.columns, n) for n in ("n_lines", "n_removed", "removed_words", "removed")]
    rows = numbered_rows(docs, key, text, [c for c in docs.columns if c != text])
    counted, gone = repeated_lines(rows.select("row", "key", "text"), min_words)
    per = gone.groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("removed"), F.sum("words").alias("removed_words"))
    x = rows.join(counted, "row", "left").join(per, "row", "left")
    parts = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
    cleaned = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    none = F.array().cast("array<int>")
    others = [c for c in docs.columns if c != text]
    out = [cleaned.alias(text) if c == text else F.col(f"doc.c{others.index(c)}").alias(c) for c in docs.columns]
    return x.select(*out, F.coalesce("n_lines", F.lit(0)).cast("bigint").alias(names[0]), F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias(names[1]),
                    F.coalesce("removed_words", F.lit(0)).cast("bigint").alias(names[2]), F.coalesce("removed", none).alias(names[3]))
