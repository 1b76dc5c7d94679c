"""Compression classifier for text quality.

Two zstandard dictionaries are built from good and bad labelled texts. A text is compressed
with each of them, in blocks, so that the dictionaries and not the text's own past carry a long text; the
normalised difference of the two sizes, with the plain compression ratio and the length beside it,
becomes a calibrated score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tracegraph.llm.calibrate import Logistic, fit_curve, for_curve, sample, texts_of, training_labels
from tracegraph.llm.common import fresh, hash60, land

BLOCK = 2048
LEVEL = 3
DICTIONARY = 65536
DICT_ROWS = 1500  # labelled texts of each class for its dictionary
DICT_BLOCKS = 8  # blocks of a text that go into it
FIT_ROWS = 12000  # labelled texts for the calibration, none of them in a dictionary


def blocks(data: bytes) -> list[bytes]:
    return [data[k:k + BLOCK] for k in range(0, len(data), BLOCK)] or [b""]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary; the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.good, self.bad = self._with(good), self._with(bad)

    def _with(self, data: bytes) -> zstandard.ZstdCompressor:
        if len(data) < 8:
            return self.plain
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)

    def features(self, text: str | None) -> tuple[float, ...]:
        data = (text or "").encode("utf-8")
        parts = blocks(data)
        good = [len(self.good.compress(p)) for p in parts]
        bad = [len(self.bad.compress(p)) for p in parts]
        g, b = sum(good), sum(bad)
        difference = (b - g) / (b + g)
        worst = min((y - x) / (x + y) for x, y in zip(good, bad))
        length = float(np.log1p(len(data)))
        return difference, worst, len(self.plain.compress(data)) / max(1, len(data)), length, difference * length


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    curve: Logistic

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with a score from 0 to 1 (1: good). The column's name is lengthened if it is taken; see ``score_name``.

        Null is scored like the empty text; every row is scored alone, so repeated rows get equal scores.
        """
        name = score_name(docs, name)
        schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
        model, columns = self, docs.columns

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tools = Compressors(model.good, model.bad)
            for batch in batches:
                x = np.array([tools.features(t.as_py()) for t in batch.column(columns.index(text))], dtype=float).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.curve(x), pa.float64())], names=[*columns, name])

        return docs.mapInArrow(add, schema)


def score_name(docs: DataFrame, name: str = "score") -> str:
    return fresh(docs.columns, name)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 42,
          dict_rows: int = DICT_ROWS, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on at most ``dict_rows`` labelled texts of each class and ``fit_rows`` others (all outside the held-out fold).

    Only these bounded samples come together: ids are broadcast, and at most DICT_BLOCKS blocks of a text and the features
    of the others reach the driver. Labels without documents are ignored; without any the score is one half.
    """
    known = land(training_labels(labels, label), "labels")
    rest = known.filter(~for_curve())
    ids = (sample(rest.filter("y = 1"), dict_rows, seed).unionByName(sample(rest.filter("y = 0"), dict_rows, seed)).withColumn("part", F.lit("d"))
           .unionByName(sample(known.filter(for_curve()), fit_rows, seed).withColumn("part", F.lit("f"))))
    texts = land(texts_of(docs, land(ids, "sample")), "sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, parts = [], []
            for y, key, t in zip(batch.column("y").to_pylist(), batch.column("h").to_pylist(), batch.column("text")):
                bs = blocks(t.as_py().encode("utf-8"))
                for k in np.random.default_rng(key).permutation(len(bs))[:DICT_BLOCKS]:
                    ys.append(y)
                    parts.append(bs[k])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(parts, pa.binary())], names=["y", "block"])

    drawn = texts.filter("part = 'd' AND text <> ''").select("y", hash60(F.col("key").cast("string")).alias("h"), "text")
    got = drawn.mapInArrow(cut, "y int, block binary").toPandas()
    good, bad = (train_dictionary(sorted(bytes(b) for b in got.loc[got["y"] == y, "block"])) for y in (1, 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(good, bad)
        for batch in batches:
            x = [list(tools.features(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    fit = texts.filter("part = 'f'").select("key", "y", "text").mapInArrow(measure, "y int, x array<double>")
    return QualityModel(good, bad, fit_curve(fit, 5))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``, all columns kept."""
    name = score_name(docs)
    return train(spark, docs, labels).score(docs).filter(F.col(name) >= threshold).drop(name)
