"""Token counts of whole texts; huge texts by overlapping chunks that are spliced where they agree.

Texts up to ``huge`` characters are cut at proven boundaries (see ``encoders``) and the counts of
the pieces come from a cache. A longer text is encoded in chunks that overlap, with offsets. In an
overlap the two encodings are spliced at a stable common boundary: a place where both have a token
boundary and where the tokenizer's pattern must cut whatever the context. Where an overlap holds
none, it is widened and the right chunk is encoded again, up to the rest of the text, so that the
count is always the library's own.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, small_batches, text_bytes
from .encoders import library, piece_cache

#: Texts of more characters are encoded in overlapping chunks of about ``CHUNK`` characters.
HUGE, CHUNK, OVERLAP = 65_536, 32_768, 256

# A cut that the pattern always makes: before white space after anything else, between a letter and
# a digit, and before ASCII punctuation after a letter. The bar is left out since the special string
# holds a letter before one.
STABLE = r"(?<=\S)(?=[ \t\n\r])|(?<=\p{L})(?=[0-9!-/:-@\[-`{}~])|(?<=[0-9])(?=\p{L})"
PIECE = rb"[\x09-\x0d\x20]*[^\x09-\x0d\x20]+|[\x09-\x0d\x20]+\Z"
# Other white space, as bytes, and the pieces of texts that hold some.
WIDE_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_PIECE = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+\Z"



def pieces_of(raw: bytes) -> list[bytes]:
    """Cut a text before each run of white space that follows something else."""
    if re.search(WIDE_SPACE, raw):
        return [p.encode() for p in re.findall(WIDE_PIECE, raw.decode())]
    return re.findall(PIECE, raw)


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def resync_count(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``; ``encode`` gives the (start, end) character offsets of the tokens of a text.

    Only two chunks are in memory at a time, unless an overlap must be widened.
    """
    stable = regex.compile(STABLE)
    counted, at = 0, 0
    end = min(len(text), chunk + overlap)
    left = encode(text[:end])
    while end < len(text):
        width, cut = overlap, None
        while cut is None:
            start = max(at, end - width)
            stop = min(len(text), start + width + chunk)
            right = encode(text[start:stop])
            left_ends = {at + b for _, b in left}
            right_starts = {start + a for a, _ in right}
            # The last pieces before the end of the left chunk may be unfinished, the first ones of
            # the right chunk may be torn: a stable place lies strictly inside both.
            cut = next((m.start() for m in stable.finditer(text, start + 1, end - 1)
                        if m.start() in left_ends and m.start() in right_starts), None)
            if cut is None and start == at:
                # Nothing to splice at in the whole left chunk: go on with one longer chunk.
                cut = at
            width *= 2
        counted += sum(at + b <= cut for _, b in left)
        left = [(start + a - cut, start + b - cut) for a, b in right if start + a >= cut]
        at, end = cut, stop
        if cut == start and stop < len(text):
            chunk *= 2
    return counted + len(left)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs``.

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted each; a null id
    stays null; other columns are ignored. An empty table gives no rows.
    """

    def counts(batch):
        texts = text_bytes(batch.column(1))
        # Only the bytes of a text are looked at first: it has no more characters than bytes.
        large = [raw.decode() if len(raw) > huge else "" for raw in texts]
        pieces = [[] if len(text) > huge else pieces_of(raw) for raw, text in zip(texts, large)]
        cache = piece_cache(path, "count", len)
        cache.prepare(pieces)
        out = []
        for text, ps in zip(large, pieces):
            if len(text) > huge:
                tool = library(path)
                out.append(resync_count(text, lambda part: tool.encode(part, add_special_tokens=False).offsets, chunk, overlap))
            else:
                out.append(sum(map(cache.__getitem__, ps)))
        sizes = [len(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.int64()), pa.array([n > limit for n in out], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_batch(counts), SCHEMA)
