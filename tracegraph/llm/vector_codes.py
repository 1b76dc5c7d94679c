"""Compression of vectors to byte codes: product quantisation with integer codebooks and exact nearest entries.

Nearest entries are found by slicing and intersecting. In every dimension the codebook's coordinates stand sorted, and
every place in that order carries a mask of the entries before it (four uint64 words for 256 entries). A radius around
a vector selects a range of places in each dimension; the masks at the two ends of the range differ by the entries inside, and the AND over
all dimensions leaves the entries in the box, which holds every entry within the radius. If the best of these candidates lies within the
radius it is the nearest of all; else the search goes on for the vector with its distance, or twice the radius, until one does.

Spark does the passes over the vectors: each task turns its batches into codes and hands on sums and counts per entry, which are added up in
an aggregate. The driver holds codebooks only (parts x entries x width integers), whose size doesn't follow the table's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracegraph.llm.common import fresh, land, least_rows

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = 1 << 27  # integer components beyond it are taken as it (that is 131,072 before scaling), so that no sum overflows
CHUNK = 1024  # vectors searched at a time
FAR = np.int64(np.iinfo(np.int64).max)


class Slices:
    """The sorted coordinates of one codebook with their prefix entry masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # entry, position
        n, width = entries.shape
        words = max(1, -(-n // 64))
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [np.ascontiguousarray(entries[order[:, j], j]) for j in range(width)]
        bit = np.zeros((n, words), np.uint64)
        bit[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.prefix = [np.concatenate([np.zeros((1, words), np.uint64), np.bitwise_or.accumulate(bit[order[:, j]], axis=0)]) for j in range(width)]
        self.all = np.bitwise_or.reduce(bit, axis=0) if n else np.zeros(words, np.uint64)
        self.radius = self._first_radius()

    def _first_radius(self) -> int:
        """The median distance from an entry to the nearest other one."""
        e = self.entries.astype(float)
        if len(e) < 2:
            return 1
        square = (e * e).sum(1)
        d = square[:, None] + square[None, :] - 2 * e @ e.T
        np.fill_diagonal(d, np.inf)
        return max(1, int(np.ceil(np.sqrt(max(0.0, float(np.median(d.min(1))))))))

    def candidates(self, q: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Flags (row of q, entry) of the entries in each row's box."""
        mask = np.broadcast_to(self.all, (len(q), len(self.all))).copy()
        for j, (coordinates, prefix) in enumerate(zip(self.sorted, self.prefix)):
            low = np.searchsorted(coordinates, q[:, j] - radius, "left")
            high = np.searchsorted(coordinates, q[:, j] + radius, "right")
            mask &= prefix[high] ^ prefix[low]
        return np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little", count=len(self.entries)).view(bool)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry (the lowest of equally near ones) and squared distance for every row of ``q``. Only entries that lie in some row's box are measured."""
        best, error = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for start in range(0, len(q), CHUNK):
            todo = np.arange(start, min(len(q), start + CHUNK))
            radius = np.full(len(todo), self.radius, np.int64)
            while len(todo):
                inside = self.candidates(q[todo], radius)
                entries = np.flatnonzero(inside.any(0))
                if len(entries):
                    d = np.where(inside[:, entries], squared_distances(q[todo], self.entries[entries]), FAR)
                    at = d.argmin(1)
                    least = d[np.arange(len(todo)), at]
                else:
                    at, least = np.zeros(len(todo), np.int64), np.full(len(todo), FAR)
                done = least <= radius * radius
                best[todo[done]], error[todo[done]] = entries[at[done]] if len(entries) else 0, least[done]
                reach = np.ceil(np.sqrt(least.astype(float))).astype(np.int64) + 1
                radius = np.where(least < FAR, reach, 2 * radius)[~done]
                todo = todo[~done]
        return best, error


def squared_distances(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Exact squared distances (row of q, row of e) of integer vectors."""
    largest = max(np.abs(q).max(initial=0), np.abs(e).max(initial=0))
    if q.shape[1] * float(2 * largest) ** 2 < 2**53:  # doubles hold every term
        a, b = q.astype(float), e.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(q), len(e)), np.int64)
    for j in range(q.shape[1]):
        out += (q[:, j, None] - e[None, :, j]) ** 2
    return out


def to_integers(vectors: pa.Array, width: int | None, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are kept (neither null nor with null or non-finite components, ``width`` long) and their integer components."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)  # nulls become nan
    ends = np.cumsum(np.maximum(sizes, 0))
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    keep = (sizes >= 0) & (bad[ends] == bad[ends - np.maximum(sizes, 0)])
    if width is None:
        return np.flatnonzero(keep), sizes
    keep &= sizes == width
    rows = np.flatnonzero(keep)
    at = (ends[rows] - width)[:, None] + np.arange(width)[None, :]
    return rows, np.clip(np.floor(flat[at.ravel()] * scale), -MOST, MOST).astype(np.int64).reshape(len(rows), width)


def kept_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """Rows (key, label, v): the integer components of every vector that can be coded, of the width of the vector with the least key."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    sound = rows.filter(F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    width = sound.agg(F.min_by(F.size("x"), F.struct(F.col("key").isNull(), "key", F.size("x")))).first()[0] or 0
    schema = rows.select("key", "label", F.array().cast("array<int>").alias("v")).schema

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = to_integers(batch.column("x"), width, scale)
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * width)
            lists = pa.ListArray.from_arrays(offsets, pa.array(v.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("key", "label")] + [lists], names=["key", "label", "v"])

    return rows.mapInArrow(integers, schema)


@dataclass(frozen=True)
class Codebooks:
    entries: np.ndarray  # part, entry, position

    def digest(self) -> str:
        """Hex SHA-256 of all components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def slices(self) -> list[Slices]:
        return [Slices(e) for e in self.entries]

    def decode(self, code: str) -> list[int]:
        """The integer components that a code stands for."""
        return np.concatenate([e[int(code[2 * p:2 * p + 2], 16)] for p, e in enumerate(self.entries)]).tolist()


def assign(slices: list[Slices], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, row) arrays of entry numbers and squared distances."""
    parts = v.reshape(len(v), len(slices), -1)
    found = [s.nearest(np.ascontiguousarray(parts[:, p])) for p, s in enumerate(slices)]
    return np.stack([f[0] for f in found]), np.stack([f[1] for f in found])


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        yield batch, batch.column("v").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, width)


def _improved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by the mean, rounded down, of the parts assigned to it; entries without any stay."""
    parts, n, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, total, count = books.slices(), np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        for _, v in _batches(batches, parts * width):
            codes, _ = assign(slices, v)
            for p in range(parts):
                count[p] += np.bincount(codes[p], minlength=n)
                order = np.argsort(codes[p], kind="stable")
                used, first = np.unique(codes[p][order], return_index=True)
                if len(used):
                    total[p, used] += np.add.reduceat(v[order, p * width:(p + 1) * width], first, axis=0)
        for p, e in zip(*np.nonzero(count)):
            cols = [np.full(width, p), np.full(width, e), np.arange(width), total[p, e], np.full(width, count[p, e])]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["part", "entry", "at", "total", "count"])

    added = vectors.mapInArrow(sums, "part bigint, entry bigint, at bigint, total bigint, count bigint").groupBy("part", "entry", "at").agg(
        F.sum("total").alias("total"), F.sum("count").alias("count"))
    got = added.toPandas()  # at most parts x entries x width rows
    new = books.entries.copy()
    new[got["part"], got["entry"], got["at"]] = got["total"].to_numpy() // got["count"].to_numpy()
    return Codebooks(new)


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of landed ``kept_vectors``: seeded with the vectors of the ``entries`` least keys, improved ``rounds`` times over all rows.

    Null keys seed nothing; of rows that repeat a key the least vector does. None without a seed or where the width can't be cut into equal parts.
    """
    seeds = least_rows(vectors.select("key").distinct(), "key", entries).orderBy("key").limit(entries)
    chosen = vectors.join(F.broadcast(seeds), "key").groupBy("key").agg(F.min("v").alias("v")).orderBy("key").collect()  # at most ``entries`` rows
    if not chosen or not chosen[0].v or len(chosen[0].v) % parts:
        return None
    seed = np.array([r.v for r in chosen], dtype=np.int64)
    books = Codebooks(np.ascontiguousarray(seed.reshape(len(seed), parts, -1).transpose(1, 0, 2)))
    for _ in range(rounds):
        books = _improved(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("key", "label")) -> DataFrame:
    """The columns ``keep`` of ``vectors`` with code (two hex digits a part) and error (squared distance to what the code stands for)."""
    parts, _, width = books.entries.shape
    schema = vectors.select(*keep, F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).schema

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = books.slices()
        for batch, v in _batches(batches, parts * width):
            codes, errors = assign(slices, v)
            text = [c.tobytes().hex() for c in codes.T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(text, pa.string()), pa.array(errors.sum(0))],
                                             names=[*keep, "code", "error"])

    return vectors.mapInArrow(coded, schema)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Codes of every vector of ``df``: key, label, code, error, label_error (errors summed over equal labels) and codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component are dropped, and so are vectors of another length than that of the
    kept row with the least key. Components saturate at ``MOST`` after scaling. Repeated rows are coded each; rows with a null key are
    coded but seed no entry; null labels form one group. A width that ``parts`` doesn't divide, or no row with a key, gives null codes and errors.
    An empty table gives no rows. Other columns are not read; columns of the result are taken by the names above, clashing ones give way.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits a part, so a codebook has 1 to 256 entries")
    vectors = land(kept_vectors(df, key, vector, label, scale), "kept-vectors")
    books = train_codebooks(vectors, parts, entries, rounds)
    name, tag = fresh(("code", "error", "label_error", "codebooks_sha256"), key), fresh(("code", "error", "label_error", "codebooks_sha256", key), label)
    if books is None:
        none = vectors.select("key", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"),
                              F.lit(None).cast("bigint").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
        return none.withColumnsRenamed({"key": name, "label": tag})
    coded = land(encode(vectors, books), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("key").alias(name), F.col("label").alias(tag), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
