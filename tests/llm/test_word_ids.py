"""Ids of columns of texts against the library."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from pairspark.llm import encoders, queries


def test_ids_against_the_library():
    rng = np.random.default_rng(8)
    parts = ["don't", "I'll'd", "'s", "''s", "x1", "A9b8", "!!'re", "<|endoftext|>", "<|x", "a<|endoftext|>b", "\u00e9A", "e\u0301", "\u65e5\u672c", "\x1c", "\x85", "\u00a0",
             " ", "  ", "\n", "\t", "\x0b", ",", "Word", "word.", "\x00", "\x7f", "y" * 90, "\U0001f600", "<", "|", ">", "_", "12345", "\u00c9T\u00c9", "\u00df\u00d7\u00f7\u00ff", "\u0130\u0131\u00b5\u00aa"]
    texts = [None, "", " ", *("".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(3000))]
    tool, own = Tokenizer.from_file(queries.WORD_BPE), encoders.WordIds(queries.WORD_BPE)
    for at in range(0, len(texts), 300):
        column = pa.array(texts, pa.string()).slice(at, 300)
        n, ids = own.of_texts(column)
        want = [tool.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert own.of_texts(pa.array([], pa.string()))[0].tolist() == []


def test_every_token_as_a_word():
    """Tokens of the vocabulary, their joins and words of a corpus give the library's ids."""
    import json

    vocab = list(json.load(open(queries.WORD_BPE))["model"]["vocab"])
    words = [t.removesuffix("</w>") for t in vocab]
    rng = np.random.default_rng(9)
    words += [a + b for a, b in zip(words, rng.permutation(words))] + ["".join(rng.choice(list("aeinrst"), rng.integers(1, 14))) for _ in range(20_000)]
    words = sorted({w for w in words if w.isascii() and w.isprintable() and " " not in w and w})
    own, tool = encoders.WordIds(queries.WORD_BPE), Tokenizer.from_file(queries.WORD_BPE)
    want = [e.ids for e in tool.encode_batch(words, add_special_tokens=False)]
    sizes, ids = own.of_words(words)
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
