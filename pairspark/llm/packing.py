"""Concatenate-and-cut packing: prefix sums in two passes, then fixed windows.

Pass one encodes every document once, keeps the ids and the running token count inside its
partition, and stores them. The partition totals, one number each, are summed up to partition
bases; a document's global offset is base plus running count. Pass two cuts the one long stream at
multiples of the sequence length. A document that crosses a cut leaves one record on each side.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release_memory, small_batches, stored
from .encoders import word_ids

SEQUENCE, END_ID = 4096, 2

#: Partition bases are broadcast up to this many partitions (16 bytes each), else joined by shuffle.
BROADCAST_PARTITIONS = 1_000_000


def encode_documents(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Pass one: ``part, local, doc_id, n, ids`` with ids as little-endian unsigned 32-bit numbers.

    ``local`` counts the ids before the document in its partition.
    """

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        part, local = TaskContext.get().partitionId(), 0
        words = word_ids(path)
        for batch in batches:
            n, flat = words.of_texts(batch.column(1))
            ids = np.insert(flat, np.cumsum(n), end_id)
            n += 1
            ends = np.cumsum(n)
            column = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, 4 * ends].astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part), pa.int64()), pa.array(local + ends - n), batch.column(0), pa.array(n), column],
                names=["part", "local", "doc_id", "n", "ids"])
            local += int(n.sum())
        release_memory()

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "part long, local long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` ids.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, then ``cut_before`` and
    ``cut_after`` (the document goes on in the sequence before or after) and ``padded_to``: every
    sequence but the last is full; the last is padded to ``length`` unless its size is a power of
    two. A null or empty text is one end id. Repeated rows are packed each; a null id stays null;
    further columns, whatever their names, are ignored; an empty table gives no rows. A text longer
    than a sequence has a piece in each sequence it spans. The order of documents is that of the
    stored partitions.
    """
    encoded = stored(encode_documents(docs, path, end_id), "packing-ids")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    # One row per partition of the input: short, also for very large inputs.
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = stored(totals.select("part", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"),
                                 F.sum("total").over(everything).alias("grand")), "packing-bases")
    if bases.count() <= BROADCAST_PARTITIONS:
        bases = F.broadcast(bases)
    placed = encoded.join(bases, "part").withColumn("first", F.col("base") + F.col("local"))
    window = F.sequence(F.floor(F.col("first") / length), F.floor((F.col("first") + F.col("n") - 1) / length))

    def piece(w):
        start = F.greatest(F.col("first"), w * length) - F.col("first")
        stop = F.least(F.col("first") + F.col("n"), (w + 1) * length) - F.col("first")
        size = stop - start
        ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (size * 4).cast("int"))
        return F.struct(start.alias("start"), size.alias("length"), F.crc32(ids).alias("ids_crc32"),
                        w.alias("sequence_id"), (F.col("first") + start - w * length).alias("offset"))

    # The pieces leave the row without its ids, so a long document is not copied per piece.
    rows = placed.select("doc_id", "n", "grand", F.explode(F.transform(window, piece)).alias("p"))
    size = F.least(F.lit(length), F.col("grand") - F.col("p.sequence_id") * length)
    power = F.bit_count(size) == 1
    return rows.select(
        "doc_id", "p.start", "p.length", "p.ids_crc32", F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset",
        (F.col("p.start") > 0).alias("cut_before"), (F.col("p.start") + F.col("p.length") < F.col("n")).alias("cut_after"),
        F.when(power, size).otherwise(F.lit(length)).cast("long").alias("padded_to"))
