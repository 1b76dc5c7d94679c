"""Toxicity from class-conditional Kneser-Ney models of the bytes of words and of words after words.

A word, with a start and an end mark, is predicted byte by byte from up to ``ORDER`` - 1 bytes before. The
highest order has discounted counts of its own in either class (toxic, ordinary); below it
both classes back off to one Kneser-Ney model of continuation counts, taken from the words of all documents, so
what neither class has seen often costs both the same. A word's evidence is the
difference of its two log-likelihoods. A second model of the same kind predicts each word from the word before it (the first one
from the text's start), its continuation counts taken from the labelled rows. The score is a logistic
curve of the signed differences of both models, summed over all tokens and divided by their number, and of the words' strong evidence:
differences below ``FLOOR`` nats, which small counts give by chance, left out, those above ``CEILING`` taken as it, n occurrences of a word
counted 1 + ln n times, so that one odd word repeated proves little; by length in words and by its root.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window, functions as F, types as T

from tracegraph.llm.calibrate import Logistic, fit_whole_curve, for_curve, training_labels
from tracegraph.llm.common import BITS, asked, bitmaps, delete, fresh, land, noting
from tracegraph.llm.warc import open_file

ORDER = 5  # bytes of the longest gram; at most 7, so that a gram fits a signed 64-bit integer
DISCOUNT = 0.75
FLOOR, CEILING = 5.0, 12.0
ID_BYTES = 64  # of an id that is broadcast
CONTEXT = 1 << 60  # marks the entry of a context
FEATURES = 4  # of a text
PORTION = 1 << 20  # letters whose words are taken at a time
LETTERS = 12 << 20  # of the texts whose word pairs are looked up together
PIECE = 1 << 20  # entries in a file of word pairs, about
KNOWN = 1_000_000  # words that a task remembers
FLUSH = 200_000  # different words that a task gathers before it hands on their grams
WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Grams (up to ORDER bytes, the last one lowest) at every byte of the words after the start mark, and the word of each."""
    coded = [b"\x01" + w.encode("utf-8") + b"\x02" for w in words]
    lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    data = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(coded)), lengths)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    code = data.copy()
    for j in range(1, ORDER):
        code[j:] |= np.where(place[j:] >= j, data[:-j] << (8 * j), 0) if j < len(data) else 0
    target = place >= 1
    return code[target], word[target]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, y) to (gram, toxic, ordinary); texts without label give grams with zero counts."""

    def out() -> pa.RecordBatch:
        listed = list(seen)
        code, word = grams_of(listed)
        grams, ix = np.unique(code, return_inverse=True)
        cols = [np.bincount(ix, np.array([c[w] for w in listed], dtype=float)[word], minlength=len(grams)) if len(grams) else np.zeros(0)
                for c in (by[1], by[0])]
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), *[pa.array(c.astype(np.int64)) for c in cols]], names=["gram", "toxic", "ordinary"])

    seen, by = set(), (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
            words = words_of(text.as_py())
            seen.update(words)
            if y is not None:
                by[y].update(words)
            if len(seen) > FLUSH:
                yield out()
                seen, by = set(), (Counter(), Counter())
    if seen:
        yield out()


def code_of(word: str) -> int:
    """A signed 64-bit code; 0 stands for the text's start."""
    code = xxhash.xxh64_intdigest(word)
    return code - (1 << 64) if code >> 63 else code


def pair_code(before: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The code of a word with the word before it."""
    return before * np.int64(-7046029254386353131) + codes


def pair_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of every word of a text with the word before it, and the code of that word."""
    before = np.concatenate([np.zeros(1, np.int64), codes[:-1]])[:len(codes)]
    return pair_code(before, codes), before


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From labelled (text, y) to (before, word, toxic, ordinary): codes of a word and the word before it, and counts."""
    for batch in batches:
        codes, ys = [], []
        for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
            c = np.array([code_of(w) for w in words_of(text.as_py())], dtype=np.int64)
            codes.append(np.stack([*pair_codes(c), c]))
            ys.append(np.full(len(c), y))
        rows, y = np.concatenate(codes, axis=1) if codes else np.zeros((3, 0), np.int64), np.concatenate(ys) if ys else np.zeros(0)
        _, at, ix = np.unique(rows[0], return_index=True, return_inverse=True)
        cols = [*rows[1:, at], *[np.bincount(ix, y == k, minlength=len(at)).astype(np.int64) for k in (1, 0)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["before", "word", "toxic", "ordinary"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = pair_code(batch.column("before").to_numpy(), batch.column("word").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("ratio")], names=["key", "ratio"])


def pair_table(counts: DataFrame) -> DataFrame:
    """Entries (key, ratio) as in ``evidence_table``: words after words, and the words before; the shared backoff is how many words a word follows.

    They come cut by ranges of the key, in order, about ``PIECE`` of them in a partition: keys are hashes, so equal ranges hold equally many.
    """
    g = counts.repartition("before").groupBy("before", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    over = Window.partitionBy("before")  # in the same stage
    g = land(g.withColumns({e: c.over(over) for e, c in _totals().items()}), "pairs")
    rows = g.count()
    contexts = g.groupBy("before").agg(*[F.max(e).alias(e) for e in _totals()])
    follows = land(g.groupBy("word").agg((F.count("*") / F.lit(max(1, rows))).alias("shared")), "words-after")
    seen = g.join(follows, "word").select("before", "word", _seen_ratio().alias("ratio")).mapInArrow(_named, "key bigint, ratio double")
    both = seen.unionByName(contexts.select((F.col("before").bitwiseXOR(F.lit(CONTEXT))).alias("key"), _unseen_ratio().alias("ratio")))
    pieces = 1 + rows // PIECE
    piece = F.shiftright((F.shiftright("key", 40) + F.lit(1 << 23)) * F.lit(pieces), 24).cast("int")
    return both.withColumn("ratio", F.col("ratio").cast("float")).repartitionById(pieces, piece).sortWithinPartitions("key")


def _totals() -> dict[str, Column]:
    """Occurrences (_t) and kinds (_m) in either class."""
    return {n: e for c in ("toxic", "ordinary") for n, e in ((f"{c}_t", F.sum(c)), (f"{c}_m", F.count(F.when(F.col(c) > 0, 1))))}


def _class_totals(grouped: GroupedData) -> DataFrame:
    return grouped.agg(*[e.alias(n) for n, e in _totals().items()])


def _weight(c: str) -> Column:
    return F.when(F.col(f"{c}_t") > 0, DISCOUNT * F.col(f"{c}_m") / F.col(f"{c}_t")).otherwise(1.0)


def _seen_ratio() -> Column:
    p = lambda c: F.when(F.col(f"{c}_t") > 0, _kept(F.col(c)) / F.col(f"{c}_t")).otherwise(0.0) + _weight(c) * F.col("shared")
    return F.log(p("toxic") / p("ordinary"))


def _unseen_ratio() -> Column:
    return F.log(_weight("toxic") / _weight("ordinary"))


def _kept(count: Column) -> Column:
    return F.greatest(count - DISCOUNT, F.lit(0.0))


def _low(code: Column, n: int) -> Column:
    """The last ``n`` bytes of a gram."""
    return code.bitwiseAND(F.lit((1 << (8 * n)) - 1))


def shared_backoff(grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (suffix, shared) for the suffixes of ORDER - 1 bytes in ``wanted``: probability of the last byte under the continuation model of that order.

    Order by order from the distinct grams down: the keys of one order's counts are what the next lower order counts. Then up
    again: a suffix takes what its order discounts from the suffix one byte shorter. Orders 1 and 2 have at most 65,792 rows.
    """
    keys, kinds = grams.select(F.col("gram").alias("suffix")), {}
    for n in range(ORDER - 1, 0, -1):
        keys = kinds[n] = land(keys.groupBy(_low(F.col("suffix"), n).alias("suffix")).agg(F.count("*").alias("c")), f"continuations-{n}")
    lower = None
    for n in range(1, ORDER):
        h = F.shiftright("suffix", 8)
        totals = kinds[n].groupBy(h.alias("h")).agg(F.sum("c").alias("t"), F.count("*").alias("m"))
        level = kinds[n].join(wanted.select(_low(F.col("suffix"), n).alias("suffix")).distinct(), "suffix", "left_semi")
        level = level.withColumn("h", h).join(totals, "h")
        if lower is None:
            level = level.withColumn("p", F.lit(1 / 256))
        else:
            short = lower.select(F.col("suffix").alias("short"), F.col("shared").alias("p"))
            level = level.withColumn("short", _low(F.col("suffix"), n - 1)).join(F.broadcast(short) if n <= 3 else short, "short")
        lower = land(level.select("suffix", ((_kept(F.col("c")) + DISCOUNT * F.col("m") * F.col("p")) / F.col("t")).alias("shared")), f"backoff-{n}")
    return lower


def evidence_table(counts: DataFrame) -> DataFrame:
    """Entries (key, ratio): log ratio of toxic to ordinary for every gram seen in a class, and for contexts the ratio of their backoff weights.

    Every one is kept. Their number follows from the words of the labelled rows that are counted, not from all documents.
    """
    g = land(counts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")
    counted = g.filter("toxic + ordinary > 0").withColumns({"h": F.shiftright("gram", 8), "suffix": _low(F.col("gram"), ORDER - 1)})
    contexts = land(_class_totals(counted.groupBy("h")), "contexts")
    joined = counted.join(contexts, "h").join(shared_backoff(g, counted.select("suffix").distinct()), "suffix")
    seen = joined.select(F.col("gram").alias("key"), _seen_ratio().alias("ratio"))
    return seen.unionByName(contexts.select((F.col("h") + CONTEXT).alias("key"), _unseen_ratio().alias("ratio")))


def _stored(table: DataFrame, name: str) -> tuple[str, ...]:
    """The files of a landed table, for ``_whole`` and ``_look_by_piece``; the driver never holds its rows."""
    return tuple(sorted(land(table.select("key", F.col("ratio").cast("float")), name).inputFiles()))


_read: dict[tuple[str, ...], tuple[np.ndarray, np.ndarray]] = {}  # of this worker, the grams of the last model


def _entries(path: str) -> tuple[np.ndarray, np.ndarray]:
    with open_file(path, "rb") as file:
        part = pq.read_table(file)
    return part["key"].to_numpy(), part["ratio"].to_numpy()


def _whole(files: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ratios) of a stored table, sorted by key."""
    if files not in _read:
        _read.clear()
        keys, ratios = map(np.concatenate, zip((np.zeros(0, np.int64), np.zeros(0, np.float32)), *map(_entries, files)))
        order = np.argsort(keys)
        _read[files] = keys[order], ratios[order]
    return _read[files]


def _look_by_piece(files: tuple[str, ...], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_look`` in a table whose files are sorted by key; one of them is held at a time, and only the keys in its range are looked up."""
    order = np.argsort(keys)
    keys = keys[order]
    hit, ratio = np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    for path in files:
        known, ratios = _entries(path)
        if len(known):
            here = slice(np.searchsorted(keys, known[0]), np.searchsorted(keys, known[-1], side="right"))
            at = np.searchsorted(known, keys[here])
            hit[order[here]] = same = known[at] == keys[here]
            ratio[order[here]] = np.where(same, ratios[at], 0)
    return hit, ratio


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the table, and its ratio; distinct keys are looked up once and in order."""
    known, ratios = table
    if not len(known) or not len(keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    keys, back = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return hit[back], np.where(hit, ratios[at], 0.0)[back]


class Evidence:
    """Evidence of words and of words after words, by table look-up; words are numbered as they are met.

    Grams stay in memory. Word pairs, which grow with the labelled rows, are read file by file for every ``LETTERS`` letters of text.
    """

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], pairs: tuple[str, ...]):
        self.grams, self.pairs = grams, pairs
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.code, self.signed, self.strong = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def learn(self, words: list[str]) -> None:
        """Of each new word the code, the signed evidence and the strong one."""
        code, word = grams_of(words)
        hit, ratio = _look(self.grams, code)
        _, back = _look(self.grams, (code >> 8) + CONTEXT)
        total = np.bincount(word, np.where(hit, ratio, back), minlength=len(words))
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.code = np.concatenate([self.code, np.fromiter(map(code_of, words), np.int64, len(words))])
        self.signed = np.concatenate([self.signed, total])
        self.strong = np.concatenate([self.strong, np.where(total > FLOOR, np.minimum(total, CEILING), 0.0)])

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row of ``FEATURES`` numbers per text. Texts go in portions of about ``LETTERS`` letters."""
        return np.concatenate([np.zeros((0, FEATURES)), *map(self._features, _portions(texts, LETTERS))])

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many words each text has, and the numbers of all of them."""
        lists = [words_of(t) for t in texts]
        if new := set().union(*lists) - self.number.keys():
            self.learn(sorted(new))
        lengths = np.array([len(w) for w in lists], np.int64)
        return lengths, np.fromiter((self.number[w] for words in lists for w in words), np.int32, int(lengths.sum()))

    def _features(self, texts: list[str | None]) -> np.ndarray:
        if len(self.number) > KNOWN:
            self.forget()
        lengths, at = map(np.concatenate, zip(*[self._numbers(part) for part in _portions(texts, PORTION)]))
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        signed = np.bincount(doc, self.signed[at], minlength=len(lengths))
        strong = np.flatnonzero(self.strong[at])
        times, n = np.unique(doc[strong].astype(np.int64) << 32 | at[strong], return_counts=True)
        heavy = np.bincount(times >> 32, self.strong[times & 0xFFFFFFFF] * (1 + np.log(n)), minlength=len(lengths))
        words = np.maximum(1, lengths)
        return np.stack([signed / words, self._pairs(doc, at, len(lengths)) / words, heavy / words, heavy / np.sqrt(words)], axis=1)

    def _pairs(self, doc: np.ndarray, at: np.ndarray, texts: int) -> np.ndarray:
        """The evidence of words after words, summed by text: a pair's own, or else that of the word before."""
        start = len(self.code)  # the number of a text's start
        before = np.concatenate([[start], at[:-1]])[:len(at)].astype(np.int32)
        before[np.flatnonzero(np.diff(doc, prepend=-1))] = start
        code = np.append(self.code, 0)
        met = np.flatnonzero(np.bincount(before, minlength=start + 1))
        hit, ratio = _look_by_piece(self.pairs, np.concatenate([pair_code(code[before], code[at]), code[met] ^ np.int64(CONTEXT)]))
        back = np.zeros(start + 1)
        back[met] = ratio[len(at):]
        return np.bincount(doc, np.where(hit[:len(at)], ratio[:len(at)], back[before]), minlength=texts)


def _portions(texts: list[str | None], letters: int) -> Iterator[list[str | None]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > letters or i + 1 == len(texts):
            yield texts[start:i + 1]
            start, size = i + 1, 0


def _measured(batches: Iterator[pa.RecordBatch], paths: tuple, text: str | int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with the features of its texts; small batches are gathered, so that word pairs are read once for many of them."""
    evidence = Evidence(_whole(paths[0]), paths[1])
    gathered, size = [], 0

    def out() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        x = evidence.features([t for b in gathered for t in b.column(text).to_pylist()])
        for b in gathered:
            yield b, x[:b.num_rows]
            x = x[b.num_rows:]

    for batch in batches:
        gathered.append(batch)
        size += batch.nbytes
        if size > LETTERS:
            yield from out()
            gathered, size = [], 0
    yield from out()


@dataclass(frozen=True)
class ToxicityModel:
    paths: tuple  # files of the stored tables: grams of the counted labelled rows, and their word pairs
    curve: Logistic

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with a score from 0 to 1 (1: toxic); a taken name is lengthened. A null text is scored like an empty one, which has no evidence."""
        name = fresh(docs.columns, name)
        schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
        model, columns = self, docs.columns

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, x in _measured(batches, model.paths, columns.index(text)):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.curve(x), pa.float64())], names=[*columns, name])

        return docs.mapInArrow(add, schema)


def _labelled(docs: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """(text, y, curve) of all documents; y is null without a label.

    Labels of ids that lie close together meet the texts as bitmaps, so that no text is shuffled however many labels there are.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    if dict(rows.dtypes)["key"] in ("int", "bigint") and dict(known.dtypes)["key"] in ("int", "bigint"):
        known, rows = known.withColumn("key", F.col("key").cast("bigint")), rows.withColumn("key", F.col("key").cast("bigint"))
        blocks, labels = known.agg(F.countDistinct(F.shiftright("key", 15)), F.count("*")).first()
        if blocks * 3 * BITS // 8 <= max(1 << 20, labels * ID_BYTES):
            marks = land(bitmaps(known, "key", toxic=F.col("y") == 1, ordinary=F.col("y") == 0, curve=F.col("curve")), "labels")
            return asked(rows, "key", marks).select("text", F.when(F.col("toxic"), 1).when(F.col("ordinary"), 0).alias("y"), "curve")
    return rows.join(known, "key", "left").select("text", "y", F.coalesce("curve", F.lit(False)).alias("curve"))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Backoff counts from all ``docs``, class counts and the curve from all labelled rows outside the held-out fold; a quarter of them only fits the curve.

    Repeated documents count as often as they occur. Without labels of both classes the score is a constant.
    """
    known = land(training_labels(labels, label).withColumn("curve", for_curve()), "labels")
    marked = _labelled(docs, known, key, text)
    counted = marked.select("text", F.when(~F.col("curve"), F.col("y")).alias("y"))
    counts = counted.mapInArrow(count_grams, "gram bigint, toxic bigint, ordinary bigint")
    pairs = counted.filter("y IS NOT NULL").mapInArrow(count_pairs, "before bigint, word bigint, toxic bigint, ordinary bigint")
    steps: list[str] = []

    def stored(build, rows: DataFrame, name: str) -> tuple[str, ...]:
        with noting(steps):
            ratios = build(rows)
        files = _stored(ratios, name)
        delete(spark, steps)  # what led to the stored table
        return files

    paths = stored(evidence_table, counts, "gram-ratios"), stored(pair_table, pairs, "pair-ratios")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _measured(batches, paths, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    fit = marked.filter("curve AND y IS NOT NULL").select("y", "text")
    return ToxicityModel(paths, fit_whole_curve(land(fit.mapInArrow(measure, "y int, x array<double>"), "curve"), FEATURES))
