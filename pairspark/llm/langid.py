"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all learnable texts. The weights are fitted on a bounded sample of
them, drawn by hash per language, with follow-the-regularised-leader and an elastic net; a part of
the sample is kept out of the fit and sets the temperature of the probabilities.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, free_name, small_batches, stored, worker_cache

FOLDS, HELD_OUT = 4, 2
ORDERS, BUCKET_BITS = (1, 2, 3), 15
#: Sampled texts per language, on average; every fifth of them calibrates. Passes of the fit.
SAMPLE, CALIBRATION, EPOCHS = 400, 5, 3
#: Learning rate and smoothing, and the L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2e-3, 1e-3
UNKNOWN = "und"
#: A language with less probability than this is not known.
LEAST_SCORE = 0.3


def ngram_counts(text: str):
    """Bucket numbers and counts of a text's lower-case character n-grams; non-letters count as spaces."""
    import numpy as np

    cache = worker_cache("langid")
    if "letters" not in cache:
        cache["letters"] = np.array([chr(c).isalpha() for c in range(0x10000)])
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kept = np.where((codes > 0xFFFF) | cache["letters"][np.minimum(codes, 0xFFFF)], codes, np.uint32(32))
    # Runs of spaces are one, and the text starts and ends with one.
    padded = np.concatenate([[np.uint32(32)], kept, [np.uint32(32)]]).astype(np.uint32)
    padded = padded[np.r_[True, (padded[1:] != 32) | (padded[:-1] != 32)]]
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    h = np.zeros(len(padded), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if order > len(padded):
            break
        h = h[:len(padded) - order + 1] * np.uint32(0x01000193) + padded[order - 1:] + np.uint32(order)
        if order in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(mixed >> np.uint32(32 - BUCKET_BITS), minlength=len(counts))
    used = np.flatnonzero(counts)
    return used, counts[used]


def tf_idf(used, counts, idf):
    import numpy as np

    value = (1 + np.log(counts)) * idf[used]
    norm = np.sqrt((value * value).sum())
    return value / norm if norm else value


def document_frequencies(texts: DataFrame) -> DataFrame:
    """``bucket, n``: texts that hold an n-gram of the bucket."""

    def run(frames):
        import numpy as np

        n = np.zeros(1 << BUCKET_BITS, np.int64)
        for frame in frames:
            for text in frame["text"]:
                n[ngram_counts(text or "")[0]] += 1
        used = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": used.astype("int32"), "n": n[used]})

    return texts.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(rows, langs: list[str], idf) -> tuple:
    """``weights, bias, temperature`` from ``(lang, used, counts, calibrates)`` rows in a fixed order."""
    import numpy as np

    size = len(idf)
    known = {lang: i for i, lang in enumerate(langs)}
    data = [(known[lang], used, tf_idf(used, counts, idf), cal) for lang, used, counts, cal in rows]
    z, n = np.zeros((len(langs), size + 1)), np.zeros((len(langs), size + 1))

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def logits(at, value, z, n):
        # The last place is the bias, free of the L1 penalty.
        return (weights(z[:, at], n[:, at], L1) * value).sum(axis=1) + weights(z[:, size], n[:, size], 0.0)

    def softmax(x):
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    for _ in range(EPOCHS):
        for label, used, value, cal in data:
            if cal:
                continue
            g = softmax(logits(used, value, z, n))
            g[label] -= 1.0
            for at, v, l1 in ((used, value, L1), (np.array([size]), np.ones(1), 0.0)):
                step = g[:, None] * v[None, :]
                w = weights(z[:, at], n[:, at], l1)
                sigma = (np.sqrt(n[:, at] + step * step) - np.sqrt(n[:, at])) / ALPHA
                z[:, at] += step - sigma * w
                n[:, at] += step * step
    w = np.hstack([weights(z[:, :size], n[:, :size], L1), weights(z[:, size:], n[:, size:], 0.0)])
    held = [(label, (w[:, used] * value).sum(axis=1) + w[:, size]) for label, used, value, cal in data if cal]
    temperature = 1.0
    if held:
        labels, scores = np.array([x for x, _ in held]), np.array([x for _, x in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        # Smoothed targets keep the temperature finite where every text is right.
        loss = [-np.log(np.clip(softmax(scores / t)[np.arange(len(labels)), labels], 1e-4, 1 - 1e-4)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return w[:, :size], w[:, size], temperature


class Model:
    """What a fit leaves: languages in order, inverse document frequencies, sparse weights, temperature."""

    def __init__(self, langs, idf, weights, bias, temperature):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def predict(self, text: str) -> tuple[str, float]:
        import numpy as np

        used, counts = ngram_counts(text)
        x = (self.weights[:, used] @ tf_idf(used, counts, self.idf) + self.bias) / self.temperature
        e = np.exp(x - x.max())
        best = int(np.argmax(e))
        return self.langs[best], float(e[best] / e.sum())


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on rows of ``docs`` outside the held-out fold that have a language.

    To the driver come one row per language, one number per bucket, and the fitted weights.
    """
    import numpy as np

    rows = small_batches(docs).select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    learn = rows.where((fold_of(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull())
    per_lang = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    langs = sorted(per_lang)
    size = 1 << BUCKET_BITS
    n = np.zeros(size)
    if not langs:
        return Model([], n, np.zeros((0, size)), np.zeros(0), 1.0)
    for r in document_frequencies(learn).collect():
        n[r["bucket"]] = r["n"]
    idf = np.log((1 + sum(per_lang.values())) / (1 + n)) + 1
    # A text is drawn by a hash of its id, at the rate that its language needs.
    rates = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, sample / count))) for lang, count in per_lang.items()])
    point = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(5)), F.lit(1 << 30)) / (1 << 30)
    drawn = learn.where(point < rates).select("doc_id", "lang", "text")

    def featurise(frames):
        for frame in frames:
            pairs = [ngram_counts(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang": frame["lang"], "used": [u.astype("<i4").tobytes() for u, _ in pairs],
                                "counts": [c.astype("<i4").tobytes() for _, c in pairs]})

    def fit_all(tables):
        frame = pd.concat(list(tables)).sort_values(["point", "used", "lang"])
        rows = [(lang, np.frombuffer(u, "<i4"), np.frombuffer(c, "<i4"), i % CALIBRATION == CALIBRATION - 1)
                for i, (lang, u, c) in enumerate(zip(frame["lang"], frame["used"], frame["counts"]))]
        w, b, t = fit(rows, langs, idf)
        yield pd.DataFrame({"weights": [w.astype("<f8").tobytes()], "bias": [b.astype("<f8").tobytes()], "temperature": [t]})

    features = stored(drawn.mapInPandas(featurise, "doc_id long, lang string, used binary, counts binary"), "langid-sample")
    # The bounded sample goes to one task.
    one = features.withColumn("point", F.xxhash64("doc_id", F.lit(7))).repartition(1)
    got = one.mapInPandas(fit_all, "weights binary, bias binary, temperature double").first()
    return Model(langs, idf, np.frombuffer(got["weights"], "<f8").reshape(len(langs), size), np.frombuffer(got["bias"], "<f8"), got["temperature"])


def predictor(model: Model):
    """A column function: text to ``struct<lang, score>``."""
    langs, unknown = model.langs, UNKNOWN
    idf, weights, bias, temperature = model.idf, model.weights, model.bias, model.temperature

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = Model(langs, idf, weights, bias, temperature)
        out = [own.predict(t) if t is not None and langs else (unknown, 0.0) for t in texts]
        return pd.DataFrame(out, columns=["lang", "score"])

    def column(text: Column) -> Column:
        # Texts without a letter never reach the model.
        text = text.cast("string")
        return predict(F.when(text.rlike(r"\p{L}"), text))

    return column


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text when
    nothing can be learned. Equal scores go to the first language by name. Repeated rows are
    predicted each; a null id is outside the held-out fold; other columns are ignored; an empty
    table gives no rows.
    """
    find = predictor(train(docs, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), find(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def with_language(docs: DataFrame, least_score: float = LEAST_SCORE, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is known with at least ``least_score``.

    Null texts and texts without a letter go; so do all rows when no language can be learned. Equal
    scores go to the first language by name; texts are read whole, long ones too. Repeated rows
    stay or go together. The id may be of any type. Further columns, whatever their names, are
    returned as they are; an empty table gives no rows.
    """
    find, name = predictor(train(docs, sample)), free_name(docs, "language")
    marked = docs.withColumn(name, find(F.col("text")))
    return marked.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= least_score)).drop(name)
