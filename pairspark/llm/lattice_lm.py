"""Language-model scores by a subword lattice.

A word's probability sums over all its segmentations: one edge for the word as a whole, if the
training texts hold it, and the lattice of the pieces of an existing vocabulary, with bytes for
what no piece covers. The forward recursion over the lattice runs in log space, many words at
once. Piece weights start from the vocabulary's own scores (a rank, read as a Zipf prior) and are
completed by how often the vocabulary's segmentation uses a piece in the distinct training words.
A document is a draw around these word probabilities (a Dirichlet prior of strength
``CONCENTRATION``), so words that a text has used already get likelier in it; its marginal
probability follows in closed form from the word counts.

Every distinct word is scored once. Documents are cut into blocks of bounded size; a block keeps
its words as numbers, the words' counts and scores come back per block, and blocks meet their own
dictionaries only. Nothing but the piece weights (bounded by the vocabulary) and four totals
reaches the driver.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, small_batches, stored, text_bytes, worker_cache

#: Bytes of text in a block; with its words a block takes some 300 MB in its worker at most.
BLOCK_BYTES = 32 << 20
FOLDS, HELD_OUT = 7, 2
#: Absolute discount of word counts, strength of the Zipf prior, strength of the document prior.
DISCOUNT, PRIOR, CONCENTRATION = 0.5, 10_000.0, 2000.0
#: Longer words take the plain recursion, which needs no table of all their pieces.
LONG_WORD = 512


def block_rows(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Word rows ``block, idx, word, c`` (c: uses in training texts) and document rows
    ``block, doc_id, held_out, n, ids, counts`` (distinct words by their idx) in one table."""

    def flush(block, words, held, doc_ids, n, pairs):
        import numpy as np

        c = np.zeros(len(words), np.int64)
        for (ids, counts), out in zip(pairs, held):
            if not out:
                c[ids] += counts
        for at in range(0, len(words), 100_000):
            part = words[at:at + 100_000]
            k = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, block)), pa.array(np.arange(at, at + k)), pa.array(part, pa.binary()), pa.array(c[at:at + k]),
                 pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())],
                names=NAMES)
        for at in range(0, len(n), 2000):
            k = len(n[at:at + 2000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, block)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()),
                 pa.array(doc_ids[at:at + k], pa.int64()), pa.array(held[at:at + k], pa.bool_()), pa.array(n[at:at + k], pa.int64()),
                 pa.array([x.astype("<i4").tobytes() for x, _ in pairs[at:at + k]], pa.binary()),
                 pa.array([x.astype("<i4").tobytes() for _, x in pairs[at:at + k]], pa.binary())],
                names=NAMES)

    def run(batches):
        import collections
        import itertools

        import numpy as np
        from pyspark import TaskContext

        blocks = itertools.count(TaskContext.get().partitionId() << 24)

        def fresh():
            return collections.defaultdict(itertools.count().__next__), [], [], [], []

        index, held, doc_ids, n, pairs = fresh()
        size = 0
        for batch in batches:
            for raw, doc_id, out in zip(text_bytes(batch.column(1)), batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                words = raw.lower().split()
                ids = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
                pairs.append(np.unique(ids, return_counts=True))
                held.append(out)
                doc_ids.append(doc_id)
                n.append(len(words))
                size += len(raw)
                if size >= block_bytes:
                    yield from flush(next(blocks), list(index), held, doc_ids, n, pairs)
                    index, held, doc_ids, n, pairs = fresh()
                    size = 0
        if n:
            yield from flush(next(blocks), list(index), held, doc_ids, n, pairs)

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(run, "block long, idx long, word binary, c long, doc_id long, held_out boolean, n long, ids binary, counts binary")


NAMES = ["block", "idx", "word", "c", "doc_id", "held_out", "n", "ids", "counts"]


def _segmenter(path: str):
    import sentencepiece

    loaded = worker_cache("sentencepiece")
    if path not in loaded:
        loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return loaded[path]


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """``piece, n``: uses of each piece in the vocabulary's own segmentation of the distinct words."""

    def run(batches):
        import numpy as np

        tool = _segmenter(path)
        counts = np.zeros(tool.get_piece_size(), np.int64)
        for batch in batches:
            words = [w.decode() for w in batch.column(0).to_pylist()]
            for at in range(0, len(words), 10_000):
                ids = [i for enc in tool.encode(words[at:at + 10_000], num_threads=1) for i in enc]
                counts += np.bincount(np.array(ids, np.int64), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["piece", "n"])

    return words.select("word").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """All segmentations of words into weighted pieces; natural logarithms."""

    MARK = "▁"

    def __init__(self, path: str, counts: dict[int, int], prior: float = PRIOR):
        import numpy as np

        tool = _segmenter(path)
        size = tool.get_piece_size()
        pieces = [tool.id_to_piece(i) for i in range(size)]
        usable = [not tool.is_control(i) and not tool.is_unknown(i) for i in range(size)]
        # The file's scores fall by rank; bytes have none and count as the last rank.
        scores = np.array([tool.get_score(i) for i in range(size)])
        ranks = np.where([tool.is_byte(i) for i in range(size)], size, -np.minimum(scores, 0)) + 2.0
        zipf = np.where(usable, 1.0 / ranks, 0.0)
        weight = prior * zipf / zipf.sum()
        for i, n in counts.items():
            if usable[i]:
                weight[i] += n
        with np.errstate(divide="ignore"):
            log = np.log(weight / weight.sum())
        self.byte = {int(pieces[i][3:5], 16): float(log[i]) for i in range(size) if tool.is_byte(i)}
        self.piece = {pieces[i]: float(log[i]) for i in range(size) if usable[i] and not tool.is_byte(i)}
        self.longest = max(map(len, self.piece))
        by_length: dict[int, list] = {}
        for p, w in self.piece.items():
            by_length.setdefault(len(p), []).append((self._hash(np.array([[*map(ord, p)]], np.uint64), len(p))[0, 0], w))
        self.tables = {k: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([w for _, w in sorted(v)])) for k, v in by_length.items()}
        self.chars: dict[int, float] = {}

    @staticmethod
    def _step(h, codes):
        return (h * 0x9E3779B97F4A7C15 + codes + 1) & 0xFFFFFFFFFFFFFFFF if isinstance(h, int) else h * h.dtype.type(0x9E3779B97F4A7C15) + codes + h.dtype.type(1)

    def _hash(self, codes, length):
        import numpy as np

        h = np.zeros((len(codes), codes.shape[1] - length + 1), np.uint64)
        for k in range(length):
            h = self._step(h, codes[:, k:codes.shape[1] - length + 1 + k])
        return h

    def _char(self, code: int) -> float:
        if code not in self.chars:
            text = self.MARK if code == 0xFFFE else chr(code)
            self.chars[code] = sum(self.byte[b] for b in text.encode())
        return self.chars[code]

    def _text(self, word: str) -> str:
        # The mark begins a word; inside one it is spelled in bytes.
        return self.MARK + word.replace(self.MARK, "￾")

    def long_word(self, word: str) -> float:
        text, ends = self._text(word), [0.0]
        for j in range(1, len(text) + 1):
            terms = [ends[-1] + self._char(ord(text[j - 1]))]
            for k in range(1, min(len(ends), self.longest) + 1):
                w = self.piece.get(text[j - k:j])
                if w is not None:
                    terms.append(ends[-k] + w)
            top = max(terms)
            ends.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            del ends[:-self.longest]
        return ends[-1]

    def same_length(self, words: list[str]):
        """Log probabilities of words of one length."""
        import numpy as np

        texts = [self._text(w) for w in words]
        size = len(texts[0])
        codes = np.array(texts, f"<U{size}").view("<u4").reshape(-1, size).astype(np.uint64)
        kinds, where = np.unique(codes, return_inverse=True)
        single = np.array([self._char(int(c)) for c in kinds])[where].reshape(codes.shape)
        edges, h = {}, np.zeros(codes.shape, np.uint64)
        for k in range(1, min(size, self.longest) + 1):
            h = self._step(h[:, :size - k + 1], codes[:, k - 1:])
            if k in self.tables:
                keys, weights = self.tables[k]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                edges[k] = np.where(keys[at] == h, weights[at], -np.inf)
        ends = np.full((size + 1, len(words)), -np.inf)
        ends[0] = 0.0
        for j in range(1, size + 1):
            terms = np.array([ends[j - 1] + single[:, j - 1], *(ends[j - k] + e[:, j - k] for k, e in edges.items() if k <= j)])
            top = terms.max(axis=0)
            ends[j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return ends[size]

    def log_probs(self, words: list[str]):
        import numpy as np

        out = np.empty(len(words))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            size = len(words[order[at]])
            if size > LONG_WORD:
                out[order[at]] = self.long_word(words[order[at]])
                at += 1
                continue
            most = max(1, 200_000 // (size + 1))
            end = at
            while end < len(order) and end - at < most and len(words[order[end]]) == size:
                end += 1
            out[order[at:end]] = self.same_length([words[i] for i in order[at:end]])
            at = end
        return out


def lgamma(x):
    """Logarithm of the gamma function of positive numbers, by Stirling's series from x + 8."""
    import numpy as np

    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def _document_scores(train_tokens: int, train_docs: int, distinct: int, kappa: float):
    """The cogroup function: documents of a block with the block's dictionary."""
    total = train_tokens + distinct + 1

    def run(docs, words):
        import numpy as np

        idx = words["idx"].to_numpy()
        c, p = np.zeros(len(idx), np.int64), np.zeros(len(idx))
        c[idx], p[idx] = words["c"].to_numpy(), words["logp"].to_numpy()
        base = np.log10((c + 1) / total)
        end_base = math.log10((train_docs + 1) / total)
        end_log = math.log((train_docs + 1) / (train_tokens + 2))
        log_kappa = math.log(kappa)
        out = []
        for n, ids, counts in zip(docs["n"].to_pylist(), docs["ids"].to_pylist(), docs["counts"].to_pylist()):
            w, k = np.frombuffer(ids, "<i4"), np.frombuffer(counts, "<i4")
            logs = p[w]
            value = float(logs.sum()) + len(w) * log_kappa + end_log + log_kappa
            again = k > 1
            if again.any():
                a = np.exp(logs[again] + log_kappa)
                value += float((lgamma(a + k[again]) - lgamma(a + 1)).sum())
            value -= math.lgamma(kappa + n + 1) - math.lgamma(kappa)
            known = int(k[c[w] > 0].sum()) + (train_docs > 0)
            out.append((n + 1, known, float((base[w] * k).sum()) + end_base, value / math.log(10)))
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        n_tokens, n_known, base_score, score = (pa.array(list(x), t) for x, t in zip(columns, kinds))
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": n_tokens, "n_known": n_known,
            "train_tokens": pa.array([train_tokens] * len(out), pa.int64()), "base_score": base_score, "score": score})

    return run


def score_documents(docs: DataFrame, vocabulary: str, block_bytes: int = BLOCK_BYTES, kappa: float = CONCENTRATION) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    A null text is empty: its one token is the end. Repeated rows are scored (and, outside the
    held-out fold, counted) each; a null id belongs to the training texts; other columns are
    ignored. Without training texts all weight comes from the vocabulary's own scores. An empty
    table gives no rows.
    """
    rows = stored(block_rows(docs, block_bytes), "lm-blocks")
    words = rows.where("idx IS NOT NULL").select("block", "idx", "word", "c")
    documents = rows.where("idx IS NULL").select("block", "doc_id", "held_out", "n", "ids", "counts")
    vocab = stored(words.groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    known = vocab.where("c > 0")
    word_tokens, types = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    train_docs = documents.where("NOT held_out").count()
    pieces = {r.piece: r.n for r in piece_counts(known, vocabulary).collect()}
    train_tokens = word_tokens + train_docs
    distinct = types + (1 if train_docs else 0)
    # Mass of the whole-word edges and of the lattice; the end token has its own share.
    inside = math.log1p(-(train_docs + 1) / (train_tokens + 2))
    escape = DISCOUNT * types / word_tokens if word_tokens else 1.0

    def word_scores(batches):
        import numpy as np

        lattice = Lattice(vocabulary, pieces)
        for batch in batches:
            c = batch.column(1).to_numpy()
            sub = lattice.log_probs([w.decode() for w in batch.column(0).to_pylist()]) + math.log(escape)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - DISCOUNT, 0.0) / max(word_tokens, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.logaddexp(whole, sub) + inside)], names=["word", "c", "logp"])

    scored = stored(vocab.select("word", "c").mapInArrow(word_scores, "word binary, c long, logp double"), "lm-scores")
    dictionary = words.select("block", "idx", "word").join(scored, "word").select(F.col("block").alias("of"), "idx", "c", "logp")
    return documents.groupBy("block").cogroup(dictionary.groupBy("of")).applyInArrow(
        _document_scores(train_tokens, train_docs, distinct, kappa),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
