"""Exact cuts for two public tokenizers, and a cache of what they make of the pieces between the cuts.

Both cut a text at white space before any merge, so a text can be encoded piece by piece:

* byte-level BPE: a match of its pattern never holds a non-space followed by a space, so the
  position between them is always a boundary, whatever stands left or right of it;
* word BPE: white space only separates; each word is encoded for itself.

Special strings hold no white space, hence none is cut.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

#: Entries after which a worker's cache starts anew, and the longest piece (bytes) it keeps: with the
#: older half some 150 MB at most.
CACHE_ENTRIES = 300_000
CACHE_PIECE = 64


def library(path: str):
    """The tokenizer of a file, loaded once per worker, single-threaded."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = worker_cache("tokenizers")
    if path not in loaded:
        loaded[path] = Tokenizer.from_file(path)
        loaded[path].no_truncation()
        loaded[path].no_padding()
    return loaded[path]


def encoded(path: str, pieces: list[str]) -> list:
    return library(path).encode_batch_fast(pieces, add_special_tokens=False)


class PieceCache(dict):
    """Piece bytes to a value made from the piece's ids.

    ``prepare`` takes the pieces of a whole batch, so the library sees each new piece once. When the
    cache is full it becomes the older half, from which pieces in use are taken over; what is not
    used again is forgotten. Long pieces last one batch.
    """

    def __init__(self, path: str, value):
        self.path, self.value, self.older, self.passing = path, value, {}, {}

    def __missing__(self, piece: bytes):
        return self.passing[piece]

    def prepare(self, lists: list[list[bytes]]) -> None:
        self.passing = {}
        if len(self) > CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        missing = set().union(*lists).difference(self)
        for piece in missing.intersection(self.older):
            self[piece] = self.older[piece]
        new = list(missing.difference(self.older))
        for at in range(0, len(new), 4096):
            part = new[at:at + 4096]
            for piece, enc in zip(part, encoded(self.path, [p.decode() for p in part])):
                (self if len(piece) <= CACHE_PIECE else self.passing)[piece] = self.value(enc)


def piece_cache(path: str, kind: str, value) -> PieceCache:
    caches = worker_cache("pieces")
    if (path, kind) not in caches:
        caches[path, kind] = PieceCache(path, value)
    return caches[path, kind]

# The characters of plain words, which lower case and composition treat one by one,
# and the parts into which the word BPE cuts such a word in lower case.
PLAIN = "[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
PARTS = "\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\na-z0-9\u00df-\u00f6\u00f8-\u00ff]+"
WORD_END = "</w>"


def _bytes_of_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: visible Latin-1 stands for itself, the rest follows from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in visible]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(others)}}


class PlainWords:
    """Ids of plain words by merge ranks.

    A part is encoded as its bytes and a space, which stands for the end of the word and is merged
    first. The rank encoder joins any two neighbours whose bytes together are a token, the
    tokenizer only the token's own two halves. Both do the same steps if only tokens are given
    ranks that the tokenizer makes of their own symbols: as long as no token crosses the ends of a
    span, merges inside happen as if it stood alone, so the last two pieces of such a token are its
    halves, and any other token is never made.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte, vocab = _bytes_of_symbols(), model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rank = {pair: i for i, pair in reversed(list(enumerate(pairs)))}

        def raw(token):
            ended = token.endswith(WORD_END)
            return bytes(byte[c] for c in (token[:-len(WORD_END)] if ended else token)) + b" " * ended

        def is_made(token):
            ended = token.endswith(WORD_END)
            at = list(token[:-len(WORD_END)] if ended else token)
            if ended:
                at[-1] += WORD_END
            while len(at) > 1:
                ranks = [rank.get(pair, len(pairs)) for pair in zip(at, at[1:])]
                least = min(ranks)
                if least == len(pairs):
                    return False
                i = ranks.index(least)
                at[i:i + 2] = [at[i] + at[i + 1]]
            return True

        symbols = [*sorted(byte, key=byte.get)]
        tokens = [*symbols, *(c + WORD_END for c in symbols if byte[c] != 32), *dict.fromkeys(a + b for a, b in pairs if is_made(a + b))]
        self.ids = np.array([vocab.get(t, 0) for t in tokens], "<u4")
        self.encoding = tiktoken.Encoding("words", pat_str=r"\n|[^ \n]+ ", special_tokens={}, mergeable_ranks={raw(t): i for i, t in enumerate(tokens)})
        self.is_plain, self.parts = re.compile(PLAIN).fullmatch, re.compile(PARTS).findall

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of ``words``, plain and without special strings, and all ids."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for at in range(0, len(words), 8192):
            parts = self.parts("\n".join([*words[at:at + 8192], ""]).lower())
            ranks = np.array(self.encoding.encode_ordinary(" ".join([*parts, ""])), np.int32)
            end = ranks == 10
            sizes.append(np.diff(np.r_[-1, np.flatnonzero(end)]) - 1)
            ids.append(self.ids[ranks[~end]])
        return np.concatenate(sizes), np.concatenate(ids)


def together(sizes, ids, order) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of items in another order, which may name an item often or never."""
    n = sizes[order]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    shift = (np.cumsum(sizes) - sizes)[order] - (ends - n)
    return n, ids[np.repeat(shift, n) + np.arange(total)]


class WordIds:
    """Ids of whole columns of texts by word BPE.

    The words of a column are numbered by Arrow, so each distinct word of a batch is encoded once.
    Plain words go to :class:`PlainWords`, which is faster than keeping words would be; all others
    go to the library.
    """

    def __init__(self, path: str):
        self.path, self.plain = path, PlainWords(path)

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of ``words``, and all ids."""
        is_plain = self.plain.is_plain
        odd = np.array([not is_plain(w) or "<|" in w for w in words], bool)
        if not odd.any():
            return self.plain.ids_of(words)
        sizes, ids = self.plain.ids_of([w for w, o in zip(words, odd) if not o])
        others = [enc.ids for enc in encoded(self.path, [w for w, o in zip(words, odd) if o])]
        sizes = np.r_[sizes, [len(x) for x in others]].astype(np.int64)
        ids = np.concatenate([ids, *(np.array(x, "<u4") for x in others)])
        # Plain words were put first.
        return together(sizes, ids, np.argsort(np.argsort(odd, kind="stable")))

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, null being empty, and the ids of all texts."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        numbered = split.flatten().dictionary_encode()
        n, ids = together(*self.of_words(numbered.dictionary.to_pylist()), numbered.indices.to_numpy())
        ends = np.r_[0, np.cumsum(n)][split.offsets.to_numpy() - split.offsets[0].as_py()]
        return np.diff(ends), ids


def word_ids(path: str) -> WordIds:
    known = worker_cache("words")
    if path not in known:
        known[path] = WordIds(path)
    return known[path]
