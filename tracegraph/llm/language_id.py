"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

1. Vocabulary: the n-grams of a bounded sample of labelled texts that at least ``MIN_DOCS`` of them hold. Letters count in lower case; whatever
   stands between them becomes one blank, so n-grams know where words begin and end.
2. Document frequencies of the vocabulary over all documents; a feature's value is (1 + ln count) * ln(N / df), rows scaled to length one.
3. Weights by follow-the-regularised-leader (per-coordinate rates, elastic net: ``L1`` keeps a weight at zero until its summed gradient passes it,
   ``L2`` shrinks the rest). The sample is dealt to leaders, one for about ``SHARD_ROWS`` rows, each of which passes ``PASSES`` times over its rows before the states are averaged, ``ROUNDS`` times.
4. Temperature: one number that divides the logits, fitted to the sample rows which no weight was learned from.

Vocabulary and weights lie in files of the shared folder that tasks read; their size follows the sample's bound, not the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tracegraph.llm.common import fresh, hash60, held_out, land, scratch_path
from tracegraph.llm.warc import open_file

NGRAMS = 4  # letters of the longest n-gram
MIN_DOCS = 3  # sampled texts that an n-gram of the vocabulary stands in
LANG_ROWS = 2000  # labelled documents of each language in the sample
SHARD_ROWS, ROUNDS, PASSES = 1000, 1, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
BINS, SALTS = 4096, 32
PIECE = 1 << 19  # letters that are coded at a time
UNKNOWN = "und"
MIX = np.int64(-7046029254386353131)

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def points_of(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text between blanks, runs of other characters made one blank; empty where there is no letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    kept = np.where(letter, raw, 32)[keep].astype(np.int64)
    head = [] if kept[0] == 32 else [32]
    return np.concatenate([np.array(head, np.int64), kept, np.array([] if kept[-1] == 32 else [32], np.int64)])


def gram_codes(points: np.ndarray, doc: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, doc) of every n-gram of 1 to ``NGRAMS`` points that lies in one document and whose last point is new; a lone blank is none.

    Up to three points a code is exact, of longer ones it is a 64-bit hash.
    """
    single = new & (points != 32)
    codes, docs = [points[single]], [doc[single]]
    code = points
    for n in range(2, NGRAMS + 1):
        code = (code[:-1] << 21 | points[n - 1:]) if n <= 3 else code[:-1] * MIX + points[n - 1:]
        inside = new[n - 1:] & (doc[n - 1:] == doc[:max(0, len(doc) - n + 1)])
        codes.append(code[inside])
        docs.append(doc[n - 1:][inside])
    return np.concatenate(codes), np.concatenate(docs)


def portions(texts: list[str | None]) -> Iterator[slice]:
    """Stretches of the texts of about ``PIECE`` letters, or one long text."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def counted(texts: list[str | None], look) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count), sorted; ``look`` turns codes into features, and negative ones are dropped.

    Long texts are coded in pieces that overlap by what an n-gram reaches back, so that every n-gram counts once.
    """
    waiting, found, size = [], [], 0

    def count() -> None:
        points = np.concatenate([p for p, _, _ in waiting])
        lengths = [len(p) for p, _, _ in waiting]
        doc = np.repeat(np.array([i for _, i, _ in waiting], np.int64), lengths)
        new = np.concatenate([np.arange(len(p)) >= old for p, _, old in waiting])
        code, at = gram_codes(points, doc, new)
        feature = look(code)
        known = feature >= 0
        found.append(np.unique(at[known] << 32 | feature[known], return_counts=True))
        waiting.clear()

    for i, text in enumerate(texts):
        points = points_of(text)
        for start in range(0, len(points), PIECE):
            old = min(start, NGRAMS - 1)
            piece = points[start - old:start + PIECE]
            waiting.append((piece, i, old))
            size += len(piece)
            if size >= PIECE:
                count()
                size = 0
    if waiting:
        count()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    key, n = (np.concatenate(c) for c in zip(*found))
    if len(found) > 1:
        key, ix = np.unique(key, return_inverse=True)
        n = np.bincount(ix, n).astype(np.int64)
    return key >> 32, key & 0xFFFFFFFF, n


class Lookup:
    """Codes to their place in a sorted vocabulary (-1 where unknown), by open addressing."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(2 * len(codes) + 1).bit_length() + 1)
        self.table, self.place = np.zeros(1 << self.bits, np.int64), np.full(1 << self.bits, -1, np.int32)
        todo, at, self.steps = np.arange(len(codes)), self._slot(codes), 0
        while len(todo):
            self.steps += 1
            free = self.place[at] < 0
            _, one = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[one]
            self.table[at[won]], self.place[at[won]] = codes[todo[won]], todo[won]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & (len(self.table) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * MIX).view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self._slot(codes)
        found = np.where(self.table[at] == codes, self.place[at], -1)
        todo = np.flatnonzero((found < 0) & (self.place[at] >= 0))
        for _ in range(self.steps - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.table) - 1)
            here = at[todo]
            hit = (self.table[here] == codes[todo]) & (self.place[here] >= 0)
            found[todo[hit]] = self.place[here[hit]]
            todo = todo[~hit & (self.place[here] >= 0)]
        return found


def rows_of(texts: list[str | None], look, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of the texts: TF-IDF, each document's values of length one."""
    doc, feature, count = counted(texts, look)
    value = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(doc, value * value, minlength=len(texts)))
    return doc, feature, value / np.maximum(norm, 1e-12)[doc]


# ---------------------------------------------------------------- learning

@dataclass
class Leader:
    """Follow-the-regularised-leader state of a multinomial model: one row per feature, the last one for the constant."""

    z: np.ndarray  # feature, language
    n: np.ndarray

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, features: np.ndarray, values: np.ndarray, y: int) -> None:
        w = self.weights(features)
        logits = values @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[y] -= 1
        g = values[:, None] * p[None, :]
        n = self.n[features]
        more = n + g * g
        self.z[features] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[features] = more


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood of ``y``, by golden section over its logarithm; 1 without rows."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(y)), y]).mean())

    a, b, r = np.log(0.02), np.log(50.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


_read: dict[str, tuple] = {}  # of this worker, the vocabulary last used


def _vocabulary(path: str) -> tuple[Lookup, np.ndarray, np.ndarray]:
    """(look-up, idf with the constant's at the end, weights or none) of a stored model."""
    if path not in _read:
        _read.clear()
        with open_file(path, "rb") as file:
            t = pq.read_table(file)
        codes, idf = t["code"].to_numpy()[:-1], t["idf"].to_numpy()
        flat = t["w"].combine_chunks().flatten().to_numpy()
        weights = flat.reshape(len(idf), len(flat) // len(idf))
        _read[path] = (Lookup(codes), idf, weights)
    return _read[path]


def _store(path: str, codes: np.ndarray, idf: np.ndarray, weights: np.ndarray | None = None) -> str:
    """One row per feature, the last one for the constant (its code is not looked up)."""
    w = pa.array(weights.tolist() if weights is not None else [[]] * len(idf), pa.list_(pa.float64()))
    with open_file(path, "wb") as file:
        pq.write_table(pa.table({"code": pa.array(np.append(codes, 0)), "idf": pa.array(idf), "w": w}), file)
    return path


def _with_constant(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int, constant: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ends = np.searchsorted(doc, np.arange(n + 1))
    for i in range(n):
        s = slice(ends[i], ends[i + 1])
        yield np.append(feature[s], constant), np.append(value[s], 1.0)


@dataclass(frozen=True)
class LanguageModel:
    path: str | None  # file of the vocabulary with its weights; none where nothing could be learned
    langs: tuple[str, ...]
    temperature: float

    def predict(self, docs: DataFrame, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
        """``docs`` with the most likely language and its calibrated probability; taken names are lengthened.

        A null text, a text without letters and every text under a model without languages is ``und`` with score 0.
        A text with letters but without known n-grams gets the language likeliest by the constant alone.
        """
        lang = fresh(docs.columns, lang)
        score = fresh([*docs.columns, lang], score)
        schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
        model, columns = self, docs.columns

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, scores = model.judge(batch.column(columns.index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, lang, score])

        return docs.mapInArrow(add, schema)

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if self.path is None:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        look, idf, w = _vocabulary(self.path)
        logits = np.concatenate([np.zeros((0, len(self.langs))), *[logits_of(texts[p], look, idf, w) for p in portions(texts)]]) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True, initial=-np.inf))
        p /= p.sum(1, keepdims=True)
        known = [any(map(str.isalpha, t or "")) for t in texts]
        return ([self.langs[k] if ok else UNKNOWN for k, ok in zip(p.argmax(1), known)],
                [float(s) if ok else 0.0 for s, ok in zip(p.max(1, initial=0.0), known)])


def logits_of(texts: list[str | None], look: Lookup, idf: np.ndarray, w: np.ndarray) -> np.ndarray:
    doc, feature, value = rows_of(texts, look, idf)
    return w[-1] + np.stack([np.bincount(doc, value * w[feature, k], minlength=len(texts)) for k in range(w.shape[1])], axis=1)


def sample_by_language(docs: DataFrame, rows: int, seed: int, key: str, text: str, lang: str) -> DataFrame:
    """Rows (key, text, lang): of every language at most ``rows`` documents outside the held-out fold, those with the least seeded hash.

    Rows without id or language are not learned from; of rows that repeat id and language the least text counts. The hash is cut by counts
    over its upper bits, so that only rows near the sample are ordered.
    """
    ids = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").cast("string").alias("lang"))
    ids = ids.filter(F.col("key").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("key"))).distinct()
    h = hash60(F.lit(str(seed)), F.col("key").cast("string"))
    ids = ids.withColumn("h", h).withColumns({"cell": F.expr(f"CAST(h div {(1 << 60) // BINS} AS INT)"), "salt": F.expr(f"CAST(h % {SALTS} AS INT)")})
    counts = ids.groupBy("lang", "cell").count()
    before = F.sum("count").over(W.partitionBy("lang").orderBy("cell")) - F.col("count")
    cut = counts.withColumn("before", before).filter(F.col("before") < rows).groupBy("lang").agg(F.max("cell").alias("last"))
    # a language may have most rows, so it is joined in salted parts
    cut = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = ids.join(cut, ["lang", "salt"]).filter("cell <= last").select("lang", "h", "key")
    chosen = land(near.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("h", "key"))).filter(F.col("nth") <= rows).select("key", "lang"), "language-ids")
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(chosen, ["key", "lang"]).groupBy("key", "lang").agg(F.min("text").alias("text"))


def train(docs: DataFrame, rows: int = LANG_ROWS, seed: int = 42, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from at most ``rows`` documents of each language; document frequencies come from all ``docs``. Without labelled rows there are no languages."""
    spark = docs.sparkSession
    sample = land(sample_by_language(docs, rows, seed, key, text, lang), "language-sample")
    langs = tuple(r.lang for r in sample.select("lang").distinct().orderBy("lang").collect())
    if not langs:
        return LanguageModel(None, (), 1.0)
    number = F.array_position(F.lit(list(langs)), F.col("lang")) - 1
    shards = max(1, -(-sample.count() // SHARD_ROWS))
    dealt = hash60(F.lit(f"{seed} shard"), F.col("key").cast("string"))
    sample = land(sample.withColumn("dealt", dealt).select("text", number.cast("int").alias("y"), (F.col("dealt") % 5 == 0).alias("spared"),
                                F.expr(f"CAST(dealt div 5 % {shards} AS INT)").alias("shard"), "key"), "language-rows")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in portions(texts):
                each = [np.zeros(0, np.int64)]
                for points in map(points_of, texts[part]):
                    each.append(np.unique(gram_codes(points, np.zeros(len(points), np.int64), np.ones(len(points), bool))[0]))
                code, n = np.unique(np.concatenate(each), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    held = sample.filter("NOT spared").select("text").mapInArrow(grams, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_DOCS)
    codes = np.sort(held.select("code").toPandas()["code"].to_numpy(dtype=np.int64))  # n-grams of the bounded sample
    base = scratch_path(spark, "language-model")
    plain = _store(f"{base}/vocabulary.parquet", codes, np.ones(len(codes) + 1))

    size = len(codes)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, _, _ = _vocabulary(plain)
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in portions(texts):
                df += np.bincount(counted(texts[part], look)[1], minlength=size)
            n += batch.num_rows
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], names=["feature", "df"])

    found = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(frequencies, "feature bigint, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    by = dict(zip(found["feature"], found["df"]))
    idf = np.append(np.log((1 + by.get(-1, 0)) / np.array([1 + by.get(i, 0) for i in range(size)], dtype=float)), 1.0)
    shape = (size + 1, len(langs))
    path = _store(f"{base}/idf.parquet", codes, idf)
    order = hash60(F.lit(f"{seed} order"), F.col("key").cast("string"))
    learning = land(sample.filter("NOT spared").select("shard", order.alias("o"), "text", "y"), "language-shards")
    state = f"{base}/state-0.npz"
    with open_file(state, "wb") as file:
        np.savez(file, z=np.zeros(shape), n=np.zeros(shape))
    for step in range(ROUNDS):
        mixed = _mixed(learning, shards, path, state, shape)
        state = f"{base}/state-{step + 1}.npz"
        with open_file(state, "wb") as file:
            np.savez(file, z=mixed.z, n=mixed.n)
    final = _store(f"{base}/weights.parquet", codes, idf, mixed.weights())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, idf, w = _vocabulary(final)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.concatenate([np.zeros((0, len(langs))), *[logits_of(texts[p], look, idf, w) for p in portions(texts)]])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["key", "y", "x"])

    spared = sample.filter("spared").select("key", "text", "y")
    logits = spared.mapInArrow(measure, spared.select("key", "y", F.array().cast("array<double>").alias("x")).schema).orderBy("key").toPandas()
    return LanguageModel(final, langs, fit_temperature(np.array(logits["x"].tolist(), dtype=float).reshape(-1, len(langs)), logits["y"].to_numpy(dtype=int)))


def _mixed(learning: DataFrame, shards: int, path: str, state: str, shape: tuple[int, int]) -> Leader:
    """One round: every shard goes on from the common state over its own rows, and the states are averaged."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]  # shards of the bounded sample
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        look, idf, _ = _vocabulary(path)
        for shard in sorted(set(table["shard"].to_pylist())):
            rows = table.filter(pc.equal(table["shard"], shard)).sort_by([("o", "ascending"), ("text", "ascending")])
            with open_file(state, "rb") as file:
                stored = np.load(file)
                leader = Leader(stored["z"], stored["n"])
            texts, ys = rows["text"].to_pylist(), rows["y"].to_pylist()
            seen = [x for part in portions(texts) for x in _with_constant(*rows_of(texts[part], look, idf), part.stop - part.start, shape[0] - 1)]
            for _ in range(PASSES):
                for (f, v), y in zip(seen, ys):
                    leader.learn(f, v, y)
            used = np.flatnonzero(leader.n.any(1))
            cols = [np.repeat(used, shape[1]), np.tile(np.arange(shape[1]), len(used)), leader.z[used].ravel(), leader.n[used].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["feature", "lang", "z", "n"])

    states = learning.repartitionByRange(shards, "shard").mapInArrow(learn, "feature bigint, lang bigint, z double, n double")
    # a sum of rounded numbers would depend on its order
    mean = lambda c: F.sum(F.col(c).cast("decimal(38, 12)")) / F.lit(shards)
    got = states.groupBy("feature", "lang").agg(mean("z").cast("double").alias("z"), mean("n").cast("double").alias("n")).toPandas()
    out = Leader(np.zeros(shape), np.zeros(shape))
    out.z[got["feature"], got["lang"]], out.n[got["feature"], got["lang"]] = got["z"], got["n"]
    return out
