"""Pieces, spans and decoded texts against the library."""

import hashlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from pairspark.llm import piece_spans, queries

PARTS = ["the", "Word", " ", "  ", "\n", "\t", "▁", "é", "é", "日本語", "\U0001f600", "ﬁ", "½", "　", "ＡＢ", "​", "\x00", "\x7f",
         "12345", "<s>", "</s>", "<unk>", "<0x41>", "ำ", "ẛ̣", "न्", "...", "�", " ", "Ω"]


def texts(seed, n=400):
    rng = np.random.default_rng(seed)
    return ["", " ", "   ", "▁", " a", "a ", "a  b", *("".join(rng.choice(PARTS, rng.integers(1, 30))) for _ in range(n))]


@pytest.mark.parametrize("block", [1, 16, 32_768])
def test_ids_and_decoded_texts(block):
    tool, library = piece_spans.SpanEncoder(queries.PIECES), sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for t in texts(1):
        ids, start, end = tool.encode(t.encode(), block)
        assert ids.tolist() == library.encode(t), t
        assert tool.decode(ids.tolist()) == library.decode(library.encode(t))
        raw = t.encode()
        # Spans rise without gaps, and each holds what its piece stands for.
        if len(ids):
            assert start[0] == 0 and end[-1] == len(raw) and (start[1:] == end[:-1]).all()
        for i, a, b in zip(ids.tolist(), start.tolist(), end.tolist()):
            piece = bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).encode()
            assert piece.replace(piece_spans.SPACE, b" ").endswith(raw[a:b].replace(piece_spans.SPACE, b" ")), t


def model_with(rule, **spec):
    """The public model with another normaliser, and the library's own tool for it."""
    with open(queries.PIECES, "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    normal = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = sentencepiece_model_pb2.ModelProto.FromString(normal.serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
    for k, v in spec.items():
        setattr(model.normalizer_spec, k, v)
    return model.SerializeToString()


@pytest.mark.parametrize("rule, spec", [("nmt_nfkc", {}), ("nmt_nfkc", {"remove_extra_whitespaces": True}), ("nfkc_cf", {"add_dummy_prefix": False}),
                                        ("identity", {"remove_extra_whitespaces": True, "add_dummy_prefix": False})])
def test_compiled_character_maps(rule, spec, tmp_path):
    path = str(tmp_path / "own.model")
    with open(path, "wb") as file:
        file.write(model_with(rule, **spec))
    tool, library = piece_spans.SpanEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert bool(tool.normalizer.map.starts) == (rule != "identity")
    for t in texts(2):
        ids, start, end = tool.encode(t.encode(), 8)
        assert ids.tolist() == library.encode(t), t
        text, *_ = tool.normalizer.normal(t.encode())
        assert text.decode() == library.normalize(t), t
        assert (start[1:] >= start[:-1]).all() and (end >= start).all() and (not len(end) or end[-1] <= len(t.encode()))


def test_spans_of_replaced_characters(tmp_path):
    path = str(tmp_path / "own.model")
    with open(path, "wb") as file:
        file.write(model_with("nmt_nfkc", remove_extra_whitespaces=True))
    tool = piece_spans.SpanEncoder(path)
    raw = "a  ﬁn Ａ".encode()
    text, start, end = tool.normalizer.normal(raw)
    assert text == "▁a▁fin▁A".encode()
    assert [(int(a), int(b)) for a, b in zip(start, end)] == [(0, 0)] * 3 + [(0, 1)] + [(1, 2)] * 3 + [(3, 6), (3, 6), (6, 7)] + [(7, 8)] * 3 + [(8, 11)]


def test_query_on_odd_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    rows = [(1, "the word"), (1, "the word"), (None, "x"), (2, None), (3, ""), (4, "long text " * 20_000), (5, "y" * 50_000), *enumerate(texts(3, 60), 10)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, n_tokens int, ids string").repartition(3)
    got = piece_spans.piece_digest(docs, queries.PIECES).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i or -1, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((t or "").encode())))
    assert sorted((r[0] or -1, *r[1:]) for r in got) == sorted(want)
    assert piece_spans.piece_digest(docs.where("false"), queries.PIECES).collect() == []
    spans = {r["doc_id"]: (r["ids"], r["starts"], r["ends"]) for r in piece_spans.encode_documents(docs.where("doc_id IN (1, 3)"), queries.PIECES).collect()}
    assert spans[3] == ([], [], []) and spans[1][1:] == ([0, 3], [3, 8])


def test_query_on_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in queries.QUERIES["op12_piece_spans"](spark, folder).collect()}
    assert got == {i: (len(ids := library.encode(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t in texts.items()}
