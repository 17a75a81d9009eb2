"""SentencePiece ids with the original byte span of every piece.

A text is normalised here, not by the library: at every place the longest prefix that the model's
compiled character map knows is replaced, anything else is copied, and each byte that comes out
keeps the place it came from. The library then only cuts what is already normal, by a copy of the
model without a normaliser. Pieces follow each other without gaps in the normal text, so the places
project each of them to the bytes of the original that it stands for.

Long texts are cut before a white space sign that follows something else. No piece holds such a
sign after another character (this is checked), so no merge crosses the cut and the ids are those of
the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, small_batches, text_bytes, worker_cache

#: Normal bytes after which a text is cut at the next safe place.
BLOCK = 32_768

SPACE = "▁".encode()
UNKNOWN_BYTES = "�".encode()


class CharacterMap:
    """Longest-prefix replacement by the compiled map of a model: a double-array trie and the texts it points to."""

    def __init__(self, blob: bytes):
        self.starts = frozenset()
        if not blob:
            return
        size = int(np.frombuffer(blob[:4], "<u4")[0])
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.texts = blob[4 + size:]
        self.starts = frozenset(b for b in range(256) if self._child(self._offset(0), b) is not None)

    def _offset(self, at: int) -> int:
        """Where the children of a node begin: its offset is stored relative to its own place."""
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _child(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        unit = self.units[at]
        return at if unit & 0x800000FF == byte else None

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``raw`` from ``at`` on."""
        base, found = self._offset(0), None
        for i in range(at, len(raw)):
            node = self._child(base, raw[i])
            if node is None:
                break
            base = self._offset(node)
            if self.units[node] & 0x100:
                start = self.units[base] & 0x7FFFFFFF
                found = (i + 1 - at, start)
        if found is None:
            return None
        return found[0], self.texts[found[1]:self.texts.index(b"\0", found[1])]


class Normalizer:
    """Normal text of a model, with the place in the original of every normal byte."""

    def __init__(self, spec, space_last: bool):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.collapse, self.dummy, self.space_last = spec.remove_extra_whitespaces, spec.add_dummy_prefix, space_last
        self.space = SPACE if spec.escape_whitespaces else b" "
        begin = b"".join(re.escape(bytes([b])) for b in sorted(self.map.starts))
        self.maybe = re.compile(b"[" + begin + b"]") if begin else None

    def _mapped(self, raw: bytes):
        """What the character map makes of ``raw``: bytes, and the start and end of the source of each."""
        if self.maybe is None:
            places = np.arange(len(raw))
            return np.frombuffer(raw, "u1"), places, places + 1
        out, starts, ends, at, copied = [], [], [], 0, 0

        def copy(upto):
            if upto > copied:
                places = np.arange(copied, upto)
                out.append(raw[copied:upto])
                starts.append(places)
                ends.append(places + 1)

        while (hit := self.maybe.search(raw, at)) is not None:
            at = hit.start()
            # Only the first byte of a character begins a prefix.
            rule = self.map.longest(raw, at) if raw[at] & 0xC0 != 0x80 else None
            if rule is None:
                at += 1
                continue
            copy(at)
            size, text = rule
            out.append(text)
            starts.append(np.full(len(text), at))
            ends.append(np.full(len(text), at + size))
            at += size
            copied = at
        copy(len(raw))
        return np.frombuffer(b"".join(out), "u1"), *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends))

    def normal(self, raw: bytes):
        """The normal bytes, and for each the start and end of its source in ``raw`` (valid UTF-8)."""
        data, start, end = self._mapped(raw)
        blank = data == 0x20
        if self.collapse:
            # Of a run of spaces one stays, at the ends of the text none.
            keep = ~blank | (np.r_[False, ~blank[:-1]] & (np.cumsum(~blank[::-1])[::-1] > 0))
            data, start, end, blank = data[keep], start[keep], end[keep], blank[keep]
        if not len(data):
            return b"", start, end
        times = np.where(blank, len(self.space), 1)
        spread = np.repeat(data, times)
        if len(self.space) > 1:
            first = (np.cumsum(times) - times)[blank]
            for i, byte in enumerate(self.space):
                spread[first + i] = byte
        text, start, end = spread.tobytes(), np.repeat(start, times), np.repeat(end, times)
        if self.dummy:
            at = len(raw) if self.space_last else 0
            none = np.full(len(self.space), at)
            text, start, end = (text + self.space, np.r_[start, none], np.r_[end, none]) if self.space_last else (self.space + text, np.r_[none, start], np.r_[none, end])
        if self.collapse:
            # Signs at the end go, also those that the original holds.
            while text.endswith(self.space):
                text = text[:-len(self.space)]
            start, end = start[:len(text)], end[:len(text)]
        return text, start, end


class SpanEncoder:
    """Ids, spans and decoded texts of a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        self.normalizer = Normalizer(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        spec = model.normalizer_spec
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        # Bytes of the normal text that a piece takes up; an unknown one is measured by the library.
        self.sizes = np.array([1 if p.type == p.BYTE else 0 if p.type == p.UNKNOWN else len(p.piece.encode()) for p in model.pieces], np.int64)
        inner = re.compile("[^▁]▁")
        self.can_cut = spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix and not any(inner.search(p.piece) for p in model.pieces)
        self.unknown = self.whole.unk_id()

    def blocks(self, text: bytes, size: int) -> list[bytes]:
        """``text`` cut at safe places, each the first after ``size`` bytes."""
        out, at = [], 0
        while self.can_cut and len(text) - at > size:
            cut = text.find(SPACE, at + size)
            while cut > 0 and text[cut - len(SPACE):cut] == SPACE:
                cut = text.find(SPACE, cut + len(SPACE))
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def encode(self, raw: bytes, block: int = BLOCK):
        """Ids of a text, and the start and end of each piece's source in its bytes.

        A byte that stands for a part of a character has that byte as its source; the white space
        that the model puts before a text has none (start and end are equal).
        """
        raw = raw.decode("utf-8", "replace").encode() if UNKNOWN_BYTES not in raw else raw
        text, start, end = self.normalizer.normal(raw)
        if not text:
            none = np.zeros(0, np.int64)
            return none, none, none
        ids, sizes = [], []
        for part in self.blocks(text, block):
            part = part.decode("utf-8", "replace")
            some = np.array(self.bare.encode(part), np.int64)
            ids.append(some)
            took = self.sizes[some]
            if (some == self.unknown).any():
                took = np.array([len(x.surface.encode()) for x in self.bare.encode(part, out_type="immutable_proto").pieces], np.int64)
            sizes.append(took)
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        stops = np.cumsum(sizes)
        return ids, start[stops - sizes], end[stops - 1]

    def decode(self, ids) -> str:
        return self.whole.decode(ids)


def span_encoder(path: str) -> SpanEncoder:
    loaded = worker_cache("span encoders")
    if path not in loaded:
        loaded[path] = SpanEncoder(path)
    return loaded[path]


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """``doc_id, ids, starts, ends`` per row of ``docs``: all ids and the byte span of each in the text.

    A null text counts as empty and has no ids. Bytes that are no UTF-8 count as U+FFFD, also in the
    spans. Repeated rows are encoded each; a null id stays null; further columns, whatever their
    names, are ignored; an empty table gives no rows. Texts are encoded whole, long ones in blocks
    that give the same ids.
    """

    def run(batch):
        tool = span_encoder(path)
        found = [tool.encode(raw, block) for raw in text_bytes(batch.column(1))]
        kind = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kind))], names=["doc_id", "ids", "starts", "ends"])

    return _texts(docs).mapInArrow(by_batch(run), "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def piece_digest(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes`` per row of ``docs``.

    Hashes are of the decimal ids joined by commas and of the text that the library decodes from
    them. ``covered_bytes`` are the bytes of the text that the pieces' spans cover. Odd rows as in
    :func:`encode_documents`.
    """

    def run(batch):
        import hashlib

        tool = span_encoder(path)
        known = worker_cache("decimal")
        decimal = known.setdefault(path, [str(i) for i in range(len(tool.sizes))])
        n, listed, decoded, covered = [], [], [], []
        for raw in text_bytes(batch.column(1)):
            ids, start, end = tool.encode(raw, block)
            own = ids.tolist()
            n.append(len(own))
            listed.append(hashlib.sha256(",".join(map(decimal.__getitem__, own)).encode()).hexdigest())
            decoded.append(hashlib.sha256(tool.decode(own).encode()).hexdigest())
            # Spans rise; pieces of one replaced character share its span.
            reached = np.r_[0, np.maximum.accumulate(end)[:-1]] if len(end) else end
            covered.append(int(np.maximum(end - np.maximum(start, reached), 0).sum()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string()), pa.array(covered, pa.int64())],
                                          names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    return _texts(docs).mapInArrow(by_batch(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
