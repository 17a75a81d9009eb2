"""Product codes of integer vectors: nearest codebook entries found in a trie over distinct parts.

A vector's components become integers and are cut into equal parts, each with a codebook of its
own. The distinct parts of a batch, in lexicographic order, form a trie: parts that begin alike
share a path. A depth-first traversal carries the distances of a path to all entries, one number
each, so a common prefix is measured once; below a node with few parts the levels are worked off
as arrays. A leaf takes the nearest entry and adds its part, times the number of its rows, to the
entry's sum. A task sends out one row per part position and entry, whatever it has read, so a round
of training is one scan and a sum of small rows: vectors are never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, release_memory, stored

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2

#: Below a trie node with at most this many parts the levels are arrays.
BLOCK = 4096

#: Scaled components from here on are refused: sums of their squares could pass 64 bits.
LARGEST = 1 << 28


class Codebooks:
    """Integer entries by part position, entry and component; all positions have equally many."""

    def __init__(self, entries):
        self.entries = np.asarray(entries, np.int64)

    def sha256(self) -> str:
        """Of all components in decimal, joined by commas, in lowercase hex."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, position: int, parts):
        """The nearest entry of each of ``parts``, which are distinct and in order, and its squared distance."""
        book = self.entries[position]
        codes, errors = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)

        def take(low, high, distances):
            codes[low:high] = distances.argmin(axis=1)
            errors[low:high] = distances.min(axis=1)

        def nodes(low, high, depth):
            """Where the parts of a range change in a component, given that they agree before it."""
            value = parts[low:high, depth]
            return low + np.flatnonzero(np.r_[True, value[1:] != value[:-1]])

        def descend(low, high, depth, path):
            if depth == parts.shape[1]:
                take(low, high, path[None, :])
            elif high - low <= BLOCK:
                opens, parent, distances = np.zeros(high - low, bool), np.zeros(high - low, np.int64), path[None, :]
                opens[0] = True
                for d in range(depth, parts.shape[1]):
                    value = parts[low:high, d]
                    opens[1:] |= value[1:] != value[:-1]
                    first = np.flatnonzero(opens)
                    distances = distances[parent[first]] + (value[first, None] - book[None, :, d]) ** 2
                    parent = np.cumsum(opens) - 1
                take(low, high, distances)
            else:
                starts = nodes(low, high, depth)
                for a, b in zip(starts, [*starts[1:], high]):
                    descend(a, b, depth + 1, path + (parts[a, depth] - book[:, depth]) ** 2)

        if len(parts):
            descend(0, len(parts), 0, np.zeros(len(book), np.int64))
        return codes, errors

    def assign(self, vectors):
        """Per part position: its distinct parts, which of them each vector has, their codes and errors."""
        width = self.entries.shape[2]
        for position in range(len(self.entries)):
            distinct, of = np.unique(vectors[:, position * width:(position + 1) * width], axis=0, return_inverse=True)
            yield distinct, of.reshape(-1), *self.nearest(position, distinct)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v``: rows whose vector is whole and finite; ``v`` holds doubles."""
    value = F.col("embedding").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None)
    return vectors.where(F.col("embedding").isNotNull()).where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), value.alias("v"))


def _matrix(column: pa.Array, dimensions: int):
    """Scaled integers, one row per vector, filled up with zeros to ``dimensions`` components."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes > dimensions).any() or (len(sizes) and sizes.min() != sizes.max()):
        raise ValueError("vectors differ in length")
    scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype("f8"))
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} or more can't be coded")
    out = np.zeros((len(column), dimensions), np.int64)
    if len(scaled):
        out[:, :sizes[0]] = scaled.reshape(len(column), -1)
    return out


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the smallest ids; of rows with one id the smallest vector counts."""

    def run(batches):
        best = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if i not in best or v < best[i]:
                    best[i] = v
            best = dict(sorted(best.items())[:entries])
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.list_(pa.float64()))], names=["vec_id", "v"])

    # At most ``entries`` rows leave a task.
    few = rows.where("vec_id IS NOT NULL").mapInArrow(run, "vec_id long, v array<double>")
    first = few.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    if not first:
        return None
    size = max(len(r["v"]) for r in first)
    width = -(-size // parts)
    start = _matrix(pa.array([r["v"] for r in first], pa.list_(pa.float64())), width * parts)
    return Codebooks(start.reshape(len(first), parts, width).transpose(1, 0, 2))


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts that are nearest to it."""
    parts, entries, width = books.entries.shape

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for batch in batches:
            for p, (distinct, of, codes, _) in enumerate(books.assign(_matrix(batch.column(2), parts * width))):
                weight = np.bincount(of, minlength=len(distinct))
                np.add.at(count[p], codes, weight)
                some = np.zeros((entries, width), np.int64)
                np.add.at(some, codes, distinct * weight[:, None])
                total[p] += some
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array([[str(x) for x in total[i, j]] for i, j in zip(p, e)], pa.list_(pa.string()))],
            names=["position", "entry", "n", "total"])
        release_memory()

    found = rows.mapInArrow(run, "position long, entry long, n long, total array<string>")
    sums = [F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"t{d}") for d in range(width)]
    moved = books.entries.copy()
    # One row per position and entry comes to the driver.
    for r in found.groupBy("position", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        moved[r["position"], r["entry"]] = [int(r[f"t{d}"]) // r["n"] for d in range(width)]
    return Codebooks(moved)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """``vec_id, label, codes, error`` per usable row of ``vectors``, and the codebooks.

    Rows whose vector is null or holds null or non-finite components are dropped. A codebook starts
    as a part of the vectors of the ``entries`` smallest ids, ascending (fewer, if there are fewer
    ids; of rows with one id the smallest vector counts; a null id starts nothing). Ties go to the
    lower entry, unused entries stay. Repeated rows count and are coded each. Vectors whose length
    isn't a multiple of ``parts`` are filled up with zeros; vectors of differing lengths and
    components of 2**20 or more are refused. Further columns are ignored; an empty table gives no
    rows and no codebooks.
    """
    rows = usable(vectors)
    books = first_codebooks(rows, parts, entries)
    if books is None:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")).where("false"), None
    for _ in range(rounds):
        books = refined(rows, books)
    width = books.entries.shape[2]

    def run(batch):
        codes, error = np.empty((batch.num_rows, parts), np.int32), np.zeros(batch.num_rows, np.int64)
        for p, (_, of, code, far) in enumerate(books.assign(_matrix(batch.column(2), parts * width))):
            codes[:, p] = code[of]
            error += far[of]
        column = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts), pa.int32()), pa.array(codes.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column, pa.array(error)], names=["vec_id", "label", "codes", "error"])

    return rows.mapInArrow(by_batch(run), "vec_id long, label string, codes array<int>, error long"), books


def code_digest(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of :func:`compress`.

    Codes are two hex digits each; ``label_error`` sums the errors of rows with the same label, null
    being one. The sums are made before the join, so a label with very many rows is one row there.
    """
    coded, books = compress(vectors, parts, entries, rounds)
    coded = stored(coded, "part-codes")
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "part-errors")
    named = sums.withColumnRenamed("label", "of")
    digits = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.join(named, coded["label"].eqNullSafe(named["of"])).select(
        "vec_id", digits.alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
