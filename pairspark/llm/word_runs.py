"""Periodic runs of words, located by block convolution.

A run is a stretch of words with smallest period ``q`` that holds the period three times or more
and that no neighbouring word extends. At scale ``B``, a power of two, runs with periods from ``B``
to ``2 B - 1`` are sought (the smallest scale takes all shorter periods too): such a run is at
least ``3 B`` long, so it holds a whole block of ``B`` words, cut at multiples of ``B``, together
with the block's copy ``q`` words on. For every block the sums of squared differences to all places
of the following windows come from one cyclic convolution per window, by a number-theoretic
transform over whole numbers; a place with sum zero is a copy. Sums below the prime are exact;
larger ones are known modulo the prime only, so a copy is compared once more, word by word. The
distances seed extensions to both sides. A text takes O(n log n) butterflies a scale, whatever it
holds; seeds inside a known run whose period divides theirs are not extended again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, small_batches, worker_cache

#: Least length of a run in words and in periods.
LEAST, TIMES = 24, 3

#: The smallest scale: 3 * 8 = 24, so a run of a smaller period still holds a block and its copy.
SMALLEST = 8

#: A prime with roots of unity of every order up to 2**27, one of its generators, and the cells that
#: are transformed at once.
PRIME, GENERATOR, CELLS = 15 * 2**27 + 1, 31, 1 << 16


def _roots(size: int, inverse: bool):
    """Twiddle factors of all levels, largest first for the forward transform."""
    known = worker_cache("roots")
    if (size, inverse) not in known:
        levels, half = [], size // 2
        while half:
            root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
            root = pow(root, PRIME - 2, PRIME) if inverse else root
            powers = np.ones(1, np.uint64)
            while len(powers) < half:
                powers = np.concatenate([powers, powers * np.uint64(pow(root, len(powers), PRIME)) % np.uint64(PRIME)])
            levels.append(powers)
            half //= 2
        known[size, inverse] = levels[::-1] if inverse else levels
    return known[size, inverse]


def transform(x):
    """Number-theoretic transform of the columns of ``x`` (size, columns), in bit-reversed order."""
    size, columns = x.shape
    p = np.uint64(PRIME)
    for powers in _roots(size, False):
        half = len(powers)
        x = x.reshape(-1, 2, half, columns)
        low, high = x[:, 0], x[:, 1]
        out = np.empty_like(x)
        total = low + high
        out[:, 0] = np.minimum(total, total - p)
        out[:, 1] = (low + (p - high)) * powers[:, None] % p
        x = out
    return x.reshape(size, columns)


def inverse(x):
    """The inverse of :func:`transform`, times the size."""
    size, columns = x.shape
    p = np.uint64(PRIME)
    for powers in _roots(size, True):
        half = len(powers)
        x = x.reshape(-1, 2, half, columns)
        low, high = x[:, 0], x[:, 1] * powers[:, None] % p
        out = np.empty_like(x)
        total, rest = low + high, low + (p - high)
        out[:, 0] = np.minimum(total, total - p)
        out[:, 1] = np.minimum(rest, rest - p)
        x = out
    return x.reshape(size, columns)


def copies(x, scale: int):
    """``row, distance`` of zero sums: row ``r`` of ``x`` (rows, ``scale``) is equal to the words ``distance`` on.

    ``x`` is one sequence, a row after the other. Distances go from ``scale`` to ``2 * scale - 1``,
    at the smallest scale from 1. Sums are modulo the prime.
    """
    rows = len(x)
    p, size = np.uint64(PRIME), 2 * scale
    flat = x.ravel().astype(np.uint64)
    squares = np.r_[np.uint64(0), np.cumsum(flat * flat % p, dtype=np.uint64)]
    # The unscaled inverse gives ``size`` times the sums of products.
    twice, out = np.uint64(2), []
    step = max(1, CELLS // size)
    for at in range(0, rows - 1, step):
        some = min(step, rows - 1 - at)
        both = np.concatenate([x[at:at + some + 1], np.vstack([x[at + 1:at + some + 1], np.full((1, scale), 0, x.dtype) if at + some + 1 >= rows else x[at + some + 1:at + some + 2]])], axis=1)
        windows = transform(np.ascontiguousarray(both.T).astype(np.uint64))
        blocks = np.zeros((size, some), np.uint64)
        blocks[:scale] = x[at:at + some, ::-1].T
        blocks = transform(blocks)
        own = squares[(np.arange(at, at + some) + 1) * scale] - squares[np.arange(at, at + some) * scale]
        for ahead in ((0, 1) if scale == SMALLEST else (1,)):
            products = inverse(blocks * windows[:, ahead:ahead + some] % p)[scale - 1:size - 1]
            begin = (np.arange(at, at + some)[None, :] + ahead) * scale + np.arange(scale)[:, None]
            end = begin + scale
            fits = end < len(squares)
            there = squares[np.where(fits, end, 0)] - squares[np.where(fits, begin, 0)]
            zero = fits & ((own[None, :] + there) % p * np.uint64(size) % p == twice * products % p)
            d, r = np.nonzero(zero)
            d = d + ahead * scale
            out.append((r[d > 0] + at, d[d > 0]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(y) for y in zip(*out))


def _same_until(a, b) -> int:
    """How long two sequences agree from their start, looked at in growing pieces."""
    n, at, step = min(len(a), len(b)), 0, 64
    a, b = a[:n], b[:n]
    while at < n:
        differ = a[at:at + step] != b[at:at + step]
        if differ.any():
            return at + int(differ.argmax())
        at += step
        step *= 2
    return n


def _divisors(q: int) -> list[int]:
    """``q`` over each of its prime factors."""
    out, rest, f = [], q, 2
    while f * f <= rest:
        if rest % f == 0:
            out.append(q // f)
            while rest % f == 0:
                rest //= f
        f += 1
    return [*out, q // rest] if rest > 1 else out


class Runs:
    """The runs of one sequence, found seed by seed at rising scales."""

    def __init__(self, words, least: int = LEAST, times: int = TIMES):
        self.words, self.least, self.times, self.found = words, least, times, set()

    def add(self, starts, distances, scale: int) -> None:
        """Extend the seeds of one scale: the words from a start agree over ``scale`` with those a distance on."""
        order = np.lexsort((starts, distances))
        starts, distances = starts[order], distances[order]
        left = np.ones(len(starts), bool)
        # Runs from smaller scales that can hold a seed.
        for start, length, period in self.found:
            if length >= 2 * scale:
                self._drop(left, starts, distances, scale, start, start + length, period)
        reached, at = {}, 0
        while True:
            more = np.flatnonzero(left[at:])
            if not len(more):
                break
            at += int(more[0])
            s, d = int(starts[at]), int(distances[at])
            left[at] = False
            if s < reached.get(d, -1):
                continue
            w = self.words
            if not (w[s:s + scale] == w[s + d:s + d + scale]).all():
                continue
            start = s - _same_until(w[:s][::-1], w[d:s + d][::-1])
            end = s + d + _same_until(w[s + d:], w[s:])
            reached[d] = end - d
            if end - start < max(self.least, self.times * d):
                continue
            if any((w[start:end - q] == w[start + q:end]).all() for q in _divisors(d)):
                continue
            self.found.add((start, end - start, d))
            self._drop(left, starts, distances, scale, start, end, d)

    @staticmethod
    def _drop(left, starts, distances, scale, start, end, period) -> None:
        left &= ~((starts >= start) & (starts + scale + distances <= end) & (distances % period == 0))


def runs_of(sequences: list, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Per sequence of whole numbers (0 or more) the ``(start, length, period)`` of its runs, in this order.

    ``times`` is 3 at least, and ``least`` three times the smallest scale at least.
    """
    if times < 3 or least < 3 * SMALLEST:
        raise ValueError("runs must hold three periods and three of the smallest blocks")
    found = [Runs(s, least, times) for s in sequences]
    scale = SMALLEST
    while True:
        long = [i for i, s in enumerate(sequences) if len(s) >= 3 * scale]
        if not long:
            break
        # Every sequence ends in a row and a half at least of a number that no sequence holds.
        rows = [-(-len(sequences[i]) // scale) + 2 for i in long]
        first = np.cumsum(rows) - rows
        joined = np.full(sum(rows) * scale, max(int(sequences[i].max()) for i in long) + 1, np.int64)
        for i, r in zip(long, first):
            joined[r * scale:r * scale + len(sequences[i])] = sequences[i]
        row, distance = copies(joined.reshape(-1, scale), scale)
        of = np.searchsorted(first, row, side="right") - 1
        sizes = np.array([len(sequences[i]) for i in long])
        start = (row - first[of]) * scale
        inside = start + scale + distance <= sizes[of]
        of, start, distance = of[inside], start[inside], distance[inside]
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]]) if len(of) else []
        for a, b in zip(cuts, [*cuts[1:], len(of)]):
            own = order[a:b]
            found[long[of[own[0]]]].add(start[own], distance[own], scale)
        scale *= 2
    return [sorted(f.found) for f in found]


def kept_words(n: int, runs):
    """Which of ``n`` words stay: not those that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def with_runs(docs: DataFrame, rewrite=None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, runs, collapsed`` per row of ``docs``.

    ``runs`` is an array of ``start, length, period`` in words, by start and period; ``collapsed``
    the words that stay, joined by spaces, when every run is cut to its first period. Words are
    told by ASCII white space and compared as they are. ``rewrite(doc_id, n)`` may give word
    numbers that take the place of a text's ``n`` words. A null text is an empty one: no runs and
    an empty string. Repeated rows are answered each; a null id stays null; further columns are
    ignored; an empty table gives no rows. Long texts are read whole.
    """
    def run(batch):
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        codes, words = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary.to_pylist()
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        # Texts that begin or end with white space have an empty word there.
        empty = words.index("") if "" in words else -1
        sequences = [own[own != empty] for own in (codes[a:b] for a, b in zip(offsets, offsets[1:]))]
        if rewrite is not None:
            places = [rewrite(i, len(s)) for i, s in zip(batch.column(0).to_pylist(), sequences)]
            sequences = [s if at is None else s[at] for s, at in zip(sequences, places)]
        runs = runs_of(sequences, least, times)
        collapsed = [" ".join(map(words.__getitem__, s[kept_words(len(s), r)].tolist() if r else s.tolist())) for s, r in zip(sequences, runs)]
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
        rows = [[{"start": a, "length": b, "period": c} for a, b, c in r] for r in runs]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), pa.array(collapsed, pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_batch(run), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted_repeat(doc_id, n: int):
    """Word numbers by which every tenth text, drawn by a hash of its id, ends in repeats of a stretch."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


def run_digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the run that repeats most often, and digests of all runs and of the collapsed text.

    Of runs with equal ratios the first by start, then by period, is shown; without a run its four
    columns are null.
    """
    # Whole numbers up to 2**31 make the products below exact.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(
        b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", "runs", best.alias("b"), F.sha2(F.encode(listed, "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period",
        F.expr("1000 * b.length DIV b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
