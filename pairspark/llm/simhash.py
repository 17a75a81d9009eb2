"""SimHash near-duplicates: exact comparison in tiles.

Equal fingerprints are one row before anything is compared. Two fingerprints within ``RADIUS``
bits agree in at least one of ``RADIUS + 1`` fields of bits, so only fingerprints that share a
field's value meet; all of them do, and no link is lost. The members of a field value are ordered
by population count and cut into tiles; a tile pair whose population counts differ by more than
the radius is skipped, any other is compared by exclusive-or and bit counts in numpy. A field
value with more than ``TILE`` members is spread over one cell per remaining tile pair before the
shuffle, so no task gets all members of a hot value. A cell sends out a spanning set of its links,
not its pairs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, small_batches, stored, text_bytes
from .linking import component_roots

SEED, SHINGLE, RADIUS = 42, 3, 2

#: Fingerprints of one tile in a cell, and of one block of the comparison in numpy.
TILE, BLOCK = 4096, 512

#: Groups up to this size are compared many at once, row against shifted row.
SMALL = 64


def shingle_hashes(raw: bytes, width: int = SHINGLE, seed: int = SEED) -> list[int]:
    """Unsigned 64-bit hashes of a text's shingles; under ``width`` words it is one shingle."""
    import itertools

    import xxhash

    words = raw.lower().split()
    if not words:
        return []
    text, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return [hash64(text, seed)]
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = itertools.chain([0], ends)
    return [hash64(text[a:b - 1], seed) for a, b in zip(starts, ends[width - 1:])]


def simhash(raw: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of a text; no words give zero."""
    import numpy as np

    hashes = shingle_hashes(raw, width, seed)
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at:at + 65_536], "<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, fp`` per row of ``docs``; a null text counts as an empty one."""

    def run(batch):
        fps = [simhash(raw) for raw in text_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], names=["doc_id", "digest", "fp"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), digest_of(F.col("text")).alias("digest"))
    return rows.mapInArrow(by_batch(run), "doc_id long, digest string, fp long")


def digest_of(text: Column) -> Column:
    return F.md5(F.encode(F.coalesce(text.cast("string"), F.lit("")), "utf-8"))


def _fields(fp: Column, radius: int) -> Column:
    """One key per field of bits: the field's number above its value."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[
        F.shiftrightunsigned(F.shiftleft(fp, 64 - b), 64 - b + a) + F.lit(i) * F.lit(1 << 40)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def _cells(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """``key, a, b, side, pop, fp``: the fingerprints of every cell that has work to do."""
    keyed = distinct.select("fp", F.bit_count("fp").cast("long").alias("pop"), F.explode(_fields(F.col("fp"), radius)).alias("key"))
    per_pop = keyed.groupBy("key", "pop").agg(F.count(F.lit(1)).alias("n"))
    first = F.lit(1 << 32)
    tiles = F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / tile) - 1), lambda i: F.col("pop") * first + i)
    # A list entry per population count and tile: 65 at least for a hot value, members / TILE at most.
    keys = per_pop.groupBy("key").agg(F.sum("n").alias("n"), F.flatten(F.collect_list(tiles)).alias("tiles"))
    keys = stored(keys.where("n > 1"), "simhash-keys")
    rows = keyed.join(keys, "key")
    cold = rows.where(F.col("n") <= tile).select(
        "key", F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("side"), "pop", "fp")
    near = rows.where(F.col("n") > tile).select(
        "key", "pop", "fp", F.filter("tiles", lambda t: F.abs(F.floor(t / first) - F.col("pop")) <= radius).alias("near"))
    own = F.filter("near", lambda t: F.floor(t / first) == F.col("pop"))
    placed = near.withColumn("side", F.element_at(own, (F.pmod(F.xxhash64("fp"), F.size(own)) + 1).cast("int")))
    hot = placed.select("key", "pop", "fp", "side", F.explode("near").alias("other")).select(
        "key", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "pop", "fp")
    return cold.unionByName(hot)


def _compare(radius: int):
    """Links of whole cells in a partition sorted by cell and population count."""

    def unite(label, i, j):
        import numpy as np

        while True:
            x, y = label[i], label[j]
            if (x == y).all():
                return
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label[:] = jumped

    def blocks(fp, pop, left, right, label):
        """Compare two runs of rows, each in order of population count, block by block."""
        import numpy as np

        for p in range(left[0], left[1], BLOCK):
            p_end = min(p + BLOCK, left[1])
            for q in range(p if left == right else right[0], right[1], BLOCK):
                q_end = min(q + BLOCK, right[1])
                if pop[q] - pop[p_end - 1] > radius or pop[p] - pop[q_end - 1] > radius:
                    continue
                i, j = np.nonzero(np.bitwise_count(fp[p:p_end, None] ^ fp[None, q:q_end]) <= radius)
                unite(label, i + p, j + q)

    def links(table):
        import numpy as np

        key, a, b, side, pop, fp = (table.column(i).to_numpy() for i in range(6))
        fp = fp.view(np.uint64)
        n = len(fp)
        label = np.arange(n)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        sizes = np.diff(np.r_[starts, n])
        left = np.repeat(np.where(sizes <= SMALL, sizes, 0), sizes) - np.where(np.repeat(sizes, sizes) <= SMALL, np.arange(n) - np.repeat(starts, sizes), 0)
        i = np.flatnonzero(left > 1)
        shift = 1
        while len(i):
            j = i + shift
            hit = (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & ((side[i] != side[j]) | (a[i] == b[i]))
            unite(label, i[hit], j[hit])
            shift += 1
            i = i[left[i] > shift]
        for s, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            if a[s] == b[s]:
                blocks(fp, pop, (s, s + size), (s, s + size), label)
            else:
                middle = s + int((side[s:s + size] == a[s]).sum())
                blocks(fp, pop, (s, middle), (middle, s + size), label)
        own = np.flatnonzero(label != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[label[own]].view(np.int64))], names=["u", "v"])

    def run(batches):
        # Whole cells are worked off once some rows are there; the last, maybe unfinished one is kept.
        kept, rows = [], 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows < 65_536:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            ends = [table.column(i)[-1] for i in range(3)]
            last = rows - 1
            import numpy as np

            same = np.logical_and.reduce([table.column(i).to_numpy() == e.as_py() for i, e in enumerate(ends)])
            last = int(np.argmax(same))
            if last:
                yield links(table.slice(0, last))
            kept, rows = table.slice(last).to_batches(), rows - last
        if rows:
            yield links(pa.Table.from_batches(kept).combine_chunks())

    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``u, v``: links of distinct fingerprints that span all pairs within ``radius`` bits."""
    cells = _cells(distinct, radius, tile).select("key", "a", "b", "side", "pop", "fp")
    cells = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side", "pop")
    return cells.mapInArrow(_compare(radius), "u long, v long")


def _labelled(docs: DataFrame, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` by fingerprint, and ``fp, root, component_id`` of every fingerprint."""
    marked = stored(fingerprints(docs), "simhash-docs")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    links = stored(fingerprint_links(distinct, radius, tile), "simhash-links")
    roots = stored(component_roots(links), "simhash-roots")
    rooted = stored(distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    named = stored(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-named")
    return marked, stored(rooted.join(named, "root").select("fp", "root", "component_id"), "simhash-labels")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``.

    The component is the smallest id reachable over links of at most ``radius`` differing bits.
    Null and empty texts have fingerprint zero and are linked like others. Repeated rows stay
    repeated; a null id stays null and names no component unless no member has an id; other
    columns are ignored; an empty table gives no rows.
    """
    marked, labels = _labelled(docs, radius, tile)
    return marked.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of ``docs``, unchanged, per component: the one with the smallest id.

    Rows without an id come last, equal ids are ordered by a digest of the text, and of repeated
    rows one stays.
    """
    marked, labels = _labelled(docs, radius, tile)
    return keep_first(docs, marked.join(labels.select("fp", "root"), "fp").select("root", "doc_id", "digest"))


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The first row of ``docs`` of each group; ``rows`` has ``root, doc_id, digest`` of every row.

    Rows without an id come last, equal ids are ordered by a digest of the text, and of rows with
    the same id and text the one stays whose columns come first as JSON.
    """
    rows = stored(rows, "copies-rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = stored(rows.groupBy("root").agg(F.min(place).alias("first")), "copies-first")
    counted = rows.join(first, "root").groupBy("root", "doc_id", "digest", place.eqNullSafe(F.col("first")).alias("wins")).agg(F.count(F.lit(1)).alias("n"))
    gone = stored(counted.where("NOT wins OR n > 1").select(F.col("doc_id").alias("id"), "digest", "wins"), "copies-gone")
    repeated = gone.where("wins").drop("wins")

    def same(table):
        return docs["doc_id"].cast("long").eqNullSafe(table["id"]) & (digest_of(docs["text"]) == table["digest"])

    out = docs.join(gone, same(gone), "left_anti")
    if repeated.limit(1).count():
        row = F.struct(*[docs[c] for c in docs.columns])
        again = docs.join(repeated, same(repeated), "left_semi").groupBy(docs["doc_id"].cast("long"), digest_of(docs["text"])).agg(
            F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("row"))
        out = out.unionByName(again.select("row.*"))
    return out
