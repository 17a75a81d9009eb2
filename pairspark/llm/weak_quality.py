"""Text quality from overlapping heuristics, without labels.

Seven heuristic labellers vote good or bad or abstain. Expectation-maximisation over the counts of
vote patterns (at most 3^7, whatever the number of texts) estimates how often each labeller is
right on either side. The posterior of a pattern is the training label of a hashed linear scorer,
which then judges every text by its features alone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import free_name, small_batches, stored, worker_cache

BAD, GOOD, ABSTAIN = 1, 2, 0
LABELLERS = ("symbols", "tables", "repeats", "function words", "lines", "length", "variety")

#: Bits of the hashed feature space; sampled texts per side (likely good, likely bad), on average; passes.
BUCKET_BITS, SAMPLE, EPOCHS = 12, 1500, 4
KEEP = 0.5

NOISE = b"#%*&$@^~<>{}[]\\|`"
# Common function words of English, French, German, Spanish.
FUNCTION_WORDS = frozenset((
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were "
    "le la les de des du et un une en que qui dans pour sur avec est au aux par ce il elle "
    "der die das und ist von den mit für auf im ein eine nicht sich auch zu dem des als "
    "el los las y que una por con para es del se su al lo como más pero").encode().split())


def signals(raw: bytes) -> tuple:
    """Shares that the labellers look at: symbols, bars, repeats, function words, double lines; words; variety."""
    from operator import eq

    words = raw.lower().split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        (len(raw) - len(raw.translate(None, NOISE))) / max(1, len(raw)),
        words.count(b"|") / max(1, n),
        sum(map(eq, words, words[1:])) / max(1, n),
        sum(map(FUNCTION_WORDS.__contains__, words)) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)) if len(lines) > 3 else 0.0,
        n,
        len(set(words)) / max(1, n),
    )


def votes(s: tuple) -> list[int]:
    symbols, bars, repeats, functions, double, n, variety = s

    def vote(bad, good):
        return BAD if bad else GOOD if good else ABSTAIN

    return [
        vote(symbols > 0.03, symbols < 0.01),
        vote(bars > 0.1, bars == 0),
        vote(repeats > 0.1, repeats < 0.03),
        vote(n >= 10 and functions < 0.05, n >= 10 and functions > 0.15),
        vote(double > 0.3, double < 0.1),
        vote(n == 0, n >= 20),
        vote(20 <= n <= 500 and variety < 0.3, 20 <= n <= 500 and variety > 0.5),
    ]


def features(raw: bytes, s: tuple):
    """Buckets and values: three-grams of character kinds, and the signals by size."""
    import numpy as np

    cache = worker_cache("quality")
    if "kinds" not in cache:
        # Letters of either case, digits, other letters (bytes above ASCII) and each sign for itself.
        kinds = np.arange(256, dtype=np.uint32)
        kinds[ord("a"):ord("z") + 1], kinds[ord("A"):ord("Z") + 1], kinds[ord("0"):ord("9") + 1], kinds[128:] = 1, 2, 3, 1
        cache["kinds"] = kinds
    k = cache["kinds"][np.frombuffer(raw, np.uint8)]
    shift = np.uint32(32 - BUCKET_BITS)
    counts = np.zeros(1 << BUCKET_BITS)
    if len(k) > 2:
        h = (k[:-2] * np.uint32(65_537) + k[1:-1] * np.uint32(257) + k[2:]) * np.uint32(0x9E3779B1)
        counts = np.sqrt(np.bincount(h >> shift, minlength=len(counts)) / len(h))
    for i, x in enumerate(s):
        step = int(np.log2(x + 1) * 2) if x > 1 else min(19, int(x * 20))
        if i != 5 and x > 0 and x < 0.05:
            step = 20
        counts[int(np.uint32((i * 64 + step + 1) * 0x85EBCA6B & 0xFFFFFFFF) >> shift)] += 0.5
    used = np.flatnonzero(counts)
    return used, counts[used]


def fit_labellers(patterns: dict[int, int], m: int = len(LABELLERS), rounds: int = 200) -> tuple[dict[int, float], list[tuple[float, float]]]:
    """Posterior of good per vote pattern, and each labeller's accuracy on good and on bad texts.

    Votes are independent given the side. The start says that labellers are mostly right, which
    tells the two sides apart; counts are smoothed by one vote either way.
    """
    import numpy as np

    codes = sorted(patterns)
    v = np.array([[c // 3**j % 3 for j in range(m)] for c in codes]).reshape(len(codes), m)
    n = np.array([patterns[c] for c in codes], float)
    good, bad = v == GOOD, v == BAD
    prior, on_good, on_bad = 0.8, np.full(m, 0.8), np.full(m, 0.8)
    post = np.full(len(codes), prior)
    for _ in range(rounds):
        log_good = np.log(prior) + good @ np.log(on_good) + bad @ np.log(1 - on_good)
        log_bad = np.log(1 - prior) + bad @ np.log(on_bad) + good @ np.log(1 - on_bad)
        post = 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))
        w, u = n * post, n * (1 - post)
        prior = (w.sum() + 1) / (n.sum() + 2)
        # A labeller is taken to be right more often than not.
        on_good = np.clip((w @ good + 1) / (w @ (good | bad) + 2), 0.5, 0.999)
        on_bad = np.clip((u @ bad + 1) / (u @ (good | bad) + 2), 0.5, 0.999)
    return dict(zip(codes, post.tolist())), list(zip(on_good.tolist(), on_bad.tolist()))


@F.pandas_udf(IntegerType())
def vote_pattern(texts: pd.Series) -> pd.Series:
    """The votes as a number in base three."""
    return pd.Series([sum(x * 3**j for j, x in enumerate(votes(signals((t or "").encode())))) for t in texts], dtype="int32")


def train(docs: DataFrame, sample: int = SAMPLE):
    """``weights`` (the last one is the bias) and the labellers' accuracies.

    To the driver come one count per vote pattern and the weights.
    """
    import numpy as np

    size = 1 << BUCKET_BITS
    marked = small_batches(docs).select(F.col("text").cast("string").alias("text")).withColumn("pattern", vote_pattern("text"))
    patterns = {r["pattern"]: r["count"] for r in marked.groupBy("pattern").count().collect()}
    posterior, accuracies = fit_labellers(patterns)
    if not patterns:
        return np.zeros(size + 1), accuracies
    sides = {side: sum(n for c, n in patterns.items() if (posterior[c] >= 0.5) == side) for side in (True, False)}
    label = F.element_at(F.create_map(*[F.lit(x) for c, p in posterior.items() for x in (c, p)]), F.col("pattern"))
    rate = F.when(label >= 0.5, F.lit(min(1.0, sample / max(1, sides[True])))).otherwise(F.lit(min(1.0, sample / max(1, sides[False]))))
    # Drawn by a hash of the text, so copies are drawn together; exact copies then count once.
    point = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) / (1 << 30)
    drawn = marked.withColumn("label", label).where(point < rate).dropDuplicates(["text"]).select("text", "label")

    def featurise(frames):
        for frame in frames:
            raws = [(t or "").encode() for t in frame["text"]]
            pairs = [features(raw, signals(raw)) for raw in raws]
            yield pd.DataFrame({"label": frame["label"], "used": [u.astype("<i4").tobytes() for u, _ in pairs],
                                "found": [v.astype("<f8").tobytes() for _, v in pairs]})

    def fit(frames):
        data = pd.concat(list(frames)).sort_values(["order", "used", "found"])
        rows = [(y, np.r_[np.frombuffer(u, "<i4"), size], np.r_[np.frombuffer(v, "<f8"), 1.0])
                for y, u, v in zip(data["label"], data["used"], data["found"])]
        w, seen = np.zeros(size + 1), np.full(size + 1, 1e-6)
        for _ in range(EPOCHS):
            for y, at, v in rows:
                g = (1 / (1 + np.exp(-np.clip(w[at] @ v, -40, 40))) - y) * v
                seen[at] += g * g
                w[at] -= 0.3 * g / np.sqrt(seen[at])
        yield pd.DataFrame({"weights": [w.astype("<f8").tobytes()]})

    sampled = stored(drawn.mapInPandas(featurise, "label double, used binary, found binary"), "quality-sample")
    got = sampled.withColumn("order", F.xxhash64("used", "found")).repartition(1).mapInPandas(fit, "weights binary").first()
    return np.frombuffer(got["weights"], "<f8"), accuracies


def scorer(weights):
    """A column function: text to the probability that it is good."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for t in texts:
            raw = (t or "").encode()
            used, found = features(raw, signals(raw))
            out.append(1 / (1 + np.exp(-np.clip(weights[used] @ found + weights[-1], -40, 40))))
        return pd.Series(out, dtype="float64")

    def column(text: Column) -> Column:
        return score(text.cast("string"))

    return column


def judge(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, score, keep`` per row of ``docs``; ``keep`` is a score of at least ``KEEP``.

    A null text is judged as an empty one. Repeated rows are judged each; a null id stays null;
    other columns are ignored; an empty table gives no rows.
    """
    weights, _ = train(docs, sample)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(weights)(F.col("text")).alias("score"))
    return found.select("doc_id", "score", (F.col("score") >= KEEP).alias("keep"))


def good_texts(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, unchanged, that :func:`judge` keeps.

    A null text is judged as an empty one; a score of exactly ``KEEP`` stays. Long texts are judged
    whole, repeated rows stay or go together. Further columns, whatever their names, are returned
    as they are; an empty table gives no rows.
    """
    weights, _ = train(docs, sample)
    name = free_name(docs, "quality")
    return docs.withColumn(name, scorer(weights)(F.col("text"))).where(F.col(name) >= KEEP).drop(name)
