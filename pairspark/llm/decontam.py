"""Benchmark decontamination by templates, with Spark expressions only.

Texts are canonicalised word by word: a number becomes ``#n``, a capitalised word inside a
sentence ``#p``, a unit after a number ``#u``; everything else is lower-cased without punctuation.
Windows of ``WINDOW`` template words are hashed and joined with the benchmark's windows, also in a
form without ``#p`` that does not depend on capitals; windows with too few plain words are matched
by their raw words instead. A pair of text and item counts once the matched windows cover ``COVERAGE`` of the item's words. If the item
has slots, the values in them are compared along each alignment, and one alignment must pass by
itself: one value of the item must always stand against one value in the text and the other way
round, which a re-parameterised question keeps and a chance match does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WINDOW, COVERAGE, CONSISTENCY = 5, 0.8, 0.8
#: Windows with fewer plain words must match word for word; items with fewer words can't be told from chance.
LEAST_PLAIN, LEAST_WORDS = 2, 3
#: Benchmark windows are broadcast up to this many rows (about 40 bytes each), else joined by shuffle.
BROADCAST_ROWS = 2_000_000

UNITS = ("mm cm m km millimeter millimeters millimetre millimetres centimeter centimeters centimetre centimetres meter meters metre metres "
         "kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles mg g kg milligram milligrams gram grams gramme grammes "
         "kilogram kilograms kilogramme kilogrammes oz ounce ounces lb lbs pound pounds ton tons tonne tonnes ml l milliliter milliliters millilitre "
         "millilitres liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months "
         "year years mph kmh cent cents dollar dollars euro euros yen percent degree degrees")
#: Signs beside a number stand for a unit's word.
SIGNS = {"%": "percent", "$": "dollar", "€": "euro", "£": "pound", "¥": "yen"}


def _whole_numbers(text: Column) -> Column:
    """A number stays one word: separators between digits become letters of it; signs become words."""
    out = F.regexp_replace(text, r"(?<=\p{Nd}),(?=\p{Nd}{3}(?!\p{Nd}))", "")
    for sign, held in ((",", "\u0002"), ("[.]", "\u0003"), ("/", "\u0004")):
        out = F.regexp_replace(out, rf"(?<=\p{{Nd}}){sign}(?=\p{{Nd}})", held)
    out = F.regexp_replace(out, r"(?<=\p{Nd}) ?%", f" {SIGNS['%']} ")
    for sign, word in SIGNS.items():
        if sign != "%":
            out = F.regexp_replace(out, rf"[{sign}] ?(?=\p{{Nd}})", f" {word} ")
    return out


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def clean(text: Column, digits: Column | None = None) -> Column:
    """Lower-cased words with single spaces; a capitalised word inside a sentence is marked.

    ``digits`` tells whether the text has a digit, if that is known already.
    """
    private = ["\u0001", "\u0002", "\u0003", "\u0004"]
    taken = F.contains(text, F.lit(private[0]))
    for mark in private[1:]:
        taken = taken | F.contains(text, F.lit(mark))
    free = F.when(taken, F.translate(text, "".join(private), " " * len(private))).otherwise(text)
    whole = F.when(has_digit(text) if digits is None else digits, _whole_numbers(free)).otherwise(free)
    marked = F.regexp_replace(whole, r"(?<=[\p{Ll}\p{Nd},;:] )(?=\p{Lu})", "\u0001")
    return F.replace(F.trim(F.lower(F.regexp_replace(marked, r"[^\p{L}\p{M}\p{N}\x{1}-\x{4}]+", " "))), F.lit("ß"), F.lit("ss"))


def unmarked(cleaned: Column) -> Column:
    """The same words whatever their capitals."""
    return F.replace(cleaned, F.lit("\u0001"), F.lit(""))


def template(cleaned: Column) -> Column:
    """The same words with typed placeholders, one for one."""
    typed = F.regexp_replace(F.regexp_replace(cleaned, r"(?<![^ ])\p{Nd}[^ ]*", "#n"), "\u0001[^ ]*", "#p")
    after = F.regexp_replace(typed, rf"(?<=#n )(?:{'|'.join(UNITS.split())})(?![^ ])", "#u")
    before = "|".join(word for sign, word in SIGNS.items() if sign != "%")
    return F.regexp_replace(after, rf"(?<![^ ])(?:{before})(?= #n)", "#u")


def _words(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def _places(words: Column, size: int) -> Column:
    """1-based window starts; none for a shorter text."""
    last = F.size(words) - size + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _windows(words: Column, size: int, made) -> Column:
    """``made(place, window)`` of every window of ``size`` words."""
    return F.transform(_places(words, size), lambda i: made(i, F.slice(words, i, size)))


def _plain(part: Column) -> Column:
    return F.size(F.filter(part, lambda x: ~x.startswith("#")))


def _hashed(words: Column) -> Column:
    """Words as numbers, so that a word is hashed once and a window combines its words' numbers."""
    return F.transform(words, lambda x: F.xxhash64(x))


def _keys(names: Column, low: Column, raw: Column) -> Column:
    """The hashes under which a window is indexed: of its words without regard to capitals, or of
    the raw words where too few are plain, and of the form with names."""
    base = F.when(_plain(low) >= LEAST_PLAIN, F.xxhash64(_hashed(low))).otherwise(F.xxhash64(raw, F.lit("raw")))
    named = F.array_contains(names, "#p") & (_plain(names) >= LEAST_PLAIN)
    return F.when(named, F.array(base, F.xxhash64(names))).otherwise(F.array(base))


def _starts(words: Column, size: int, slot: str, back: int) -> Column:
    """Starts of windows that hold a word starting with ``slot`` among their first ``back + 1`` words."""
    at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.get(words, i - 1).startswith(slot))
    around = F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - back, F.lit(1)), p)))
    return F.filter(F.array_distinct(around), lambda i: i <= F.size(words) - size + 1)


def _hashes(sizes: list[int]) -> Column:
    """All keys of the windows of the words ``m, l, r`` and the hashed words ``lh``, see :func:`_lean_forms`.

    Only windows near a placeholder are looked at a second time: one with fewer than two plain
    words (``LEAST_PLAIN``) has a placeholder first or second.
    """
    none = F.array().cast("array<bigint>")
    out = []
    for s in sizes:
        out.append(F.transform(_places(F.col("lh"), s), lambda i: F.xxhash64(*[F.get("lh", i + (j - 1)) for j in range(s)])))
        few = _places(F.col("l"), 1) if s < LEAST_PLAIN else F.filter(
            _starts(F.col("l"), s, "#", LEAST_PLAIN - 1), lambda i: _plain(F.slice("l", i, s)) < LEAST_PLAIN)
        some = F.array_contains("l", "#n") | F.lit(s < LEAST_PLAIN)
        out.append(F.when(some, F.transform(few, lambda i: F.xxhash64(F.slice("r", i, s), F.lit("raw")))).otherwise(none))
        named = F.transform(_starts(F.col("m"), s, "\u0001", s - 1), lambda i: F.xxhash64(F.transform(
            F.sequence(i, i + (s - 1)), lambda j: F.when(F.get("m", j - 1).startswith("\u0001"), F.lit("#p")).otherwise(F.get("l", j - 1)))))
        out.append(F.when(F.col("marked"), named).otherwise(none))
    return F.array_distinct(F.concat(*out))


def _forms(cleaned: Column) -> list[Column]:
    """``t, l, r``: the words with all placeholders, with those of numbers and units, and as they are."""
    raw = unmarked(cleaned)
    return [_words(template(cleaned)).alias("t"), _words(template(raw)).alias("l"), _words(raw).alias("r")]


def _lean_forms(texts: DataFrame) -> DataFrame:
    """``digest, marked, m, l, r, lh``: the forms of whole texts, each made only where it differs.

    ``m`` are the words with their marks; one of ``t`` is ``#p`` where ``m`` is marked, else that of
    ``l``, and ``l`` is ``r``, the words as they are, in texts without digits. Each step is a column,
    so nothing is made twice.
    """
    found = texts.select("digest", "text", has_digit(F.col("text")).alias("digits"))
    found = found.select("digest", "digits", clean(F.col("text"), F.col("digits")).alias("c"))
    found = found.select("digest", "digits", "c", F.contains("c", F.lit("\u0001")).alias("marked"), _words(F.col("c")).alias("m"))
    bare = F.when(F.col("marked"), F.transform("m", unmarked)).otherwise(F.col("m"))
    found = found.select("digest", "digits", "c", "marked", "m", bare.alias("r"))
    low = F.when(F.col("digits"), _words(template(unmarked(F.col("c"))))).otherwise(F.col("r"))
    return found.select("digest", "marked", "m", "r", low.alias("l")).withColumn("lh", _hashed(F.col("l")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """``item_id, words, slots, size, place, h, kinds, raw`` per window of each item of ``least_words`` or more."""
    cleaned = benchmark.select("item_id", clean(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("c"))
    items = cleaned.select("item_id", "c", *_forms(F.col("c"))).where(F.size("t") >= max(least_words, 1))
    items = items.dropDuplicates(["item_id", "c"])
    size = F.least(F.lit(window), F.size("t"))
    rows = items.select(
        F.col("item_id").cast("long").alias("item_id"), F.xxhash64("c").alias("variant"), F.size("t").alias("words"),
        F.size(F.filter("t", lambda x: x.startswith("#"))).alias("slots"), size.alias("size"), "t", "l", "r",
        F.explode(F.sequence(F.lit(1), F.size("t") - size + 1)).alias("place"))
    part, low, raw = (F.slice(k, F.col("place"), F.col("size")) for k in "tlr")
    rows = rows.select("item_id", "variant", "words", "slots", "size", "place", part.alias("kinds"), low.alias("low"), raw.alias("raw"))
    return rows.withColumn("h", F.explode(_keys(F.col("kinds"), F.col("low"), F.col("raw")))).drop("low")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistency: float = CONSISTENCY,
                 least_words: int = LEAST_WORDS) -> DataFrame:
    """``digest, item_id, coverage, consistency, reparameterised`` per pair of a distinct text (by
    md5) and the item it holds; see :func:`leaks` for rows by document.

    Null and empty texts match nothing. Items under ``window`` words match as one window of their
    own size; those of one or two words are looked for only with ``least_words`` 1 or 2 and then
    flag every text that holds the word, or both in order. Repeated items count once.
    """
    bench = stored(benchmark_windows(benchmark, window, least_words), "decontam-benchmark")
    sizes = sorted({window} | {r["size"] for r in bench.select("size").distinct().collect()})
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''")
    texts = texts.select(F.md5(F.encode("text", "utf-8")).alias("digest"), "text")
    index = bench.select("h", "item_id", "variant", "place")
    if bench.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    found = _lean_forms(texts).select("digest", F.explode(_hashes(sizes)).alias("h"))
    hits = found.join(index, "h").groupBy("digest", "item_id", "variant").agg(F.collect_set("place").alias("places"))
    # A list of places is no longer than its item.
    items = bench.select("item_id", "variant", "words", "slots", "size").distinct()
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1)))))
    pairs = hits.join(F.broadcast(items) if bench.count() <= BROADCAST_ROWS else items, ["item_id", "variant"])
    pairs = stored(pairs.select("digest", "item_id", "variant", "slots", "words", (covered / F.col("words")).alias("coverage"))
                   .where(F.col("coverage") >= coverage), "decontam-pairs")
    plain = pairs.where("slots = 0").select("digest", "item_id", "coverage", F.lit(1.0).alias("consistency"), F.lit(False).alias("reparameterised"))
    slotted = pairs.where("slots > 0")
    aligned = _alignments(texts, slotted, bench, sizes).where((F.col("coverage") >= coverage) & (F.col("consistency") >= consistency))
    every = plain.unionByName(aligned.select("digest", "item_id", "coverage", "consistency", F.col("changed").alias("reparameterised")))
    # Of several alignments that pass the most consistent one is told.
    best = F.max(F.struct("consistency", "coverage", (~F.col("reparameterised")).alias("kept"))).alias("best")
    return every.groupBy("digest", "item_id").agg(best).select("digest", "item_id", "best.coverage", "best.consistency", (~F.col("best.kept")).alias("reparameterised"))


def _raw_windows(size: int) -> Column:
    return _windows(F.col("t"), size, lambda i, part: F.struct(
        i.alias("at"), _keys(part, F.slice("l", i, size), F.slice("r", i, size)).alias("keys"), F.slice("r", i, size).alias("text_raw")))


def _alignments(texts: DataFrame, pairs: DataFrame, bench: DataFrame, sizes: list[int]) -> DataFrame:
    """``digest, item_id, variant, coverage, consistency, changed`` per alignment of each pair.

    An alignment is a shift of the item in the text, a run of shifts no further apart than a window
    (words were added or left out), or all shifts. The consistency is the share of slots whose item
    value always meets one value of the text, which meets no other value of the item.
    """
    wanted = pairs.select("digest").distinct()
    few = texts.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    cleaned = few.select("digest", clean(F.col("text")).alias("c"))
    words = cleaned.select("digest", *_forms(F.col("c")))
    opened = [words.select("digest", F.explode(_raw_windows(s)).alias("w")).select("digest", "w.*") for s in sizes]
    every = opened[0]
    for more in opened[1:]:
        every = every.unionByName(more)
    every = every.select("digest", "at", "text_raw", F.explode("keys").alias("h"))
    index = bench.select("h", "item_id", "variant", "place", "size", "kinds", "raw")
    pair = ["digest", "item_id", "variant"]
    met = every.join(index, "h").join(pairs.select(*pair, "words"), pair).withColumn("shift", F.col("at") - F.col("place"))
    met = stored(met.select(*pair, "words", "shift", "place", "size", "kinds", "raw", "text_raw"), "decontam-met")
    places = met.groupBy(*pair, "words", "shift", "size").agg(F.collect_set("place").alias("places"))
    slots = met.select(*pair, "shift", "place", F.posexplode("kinds").alias("k", "kind"), "raw", "text_raw")
    slots = slots.where(F.col("kind").startswith("#")).select(
        *pair, "shift", (F.col("place") + F.col("k")).alias("slot"),
        F.get("raw", F.col("k")).alias("of_item"), F.get("text_raw", F.col("k")).alias("of_text")).distinct()
    met_values = slots.groupBy(*pair, "shift", "of_item", "of_text").agg(F.count(F.lit(1)).alias("n"))
    # Windows over one item's slots at one shift, both on the same partitioning.
    held, meets = (Window.partitionBy(*pair, "shift", c) for c in ("of_item", "of_text"))
    one_to_one = (F.count(F.lit(1)).over(held) == 1) & (F.count(F.lit(1)).over(meets) == 1)
    by_value = met_values.repartition(*pair, "shift").select(
        *pair, "shift", "n", one_to_one.alias("same"), (F.col("of_text") != F.col("of_item")).alias("changed"))
    by_shift = by_value.groupBy(*pair, "shift").agg(
        F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("n"), F.max("changed").alias("changed"))
    along = Window.partitionBy(*pair).orderBy("shift")
    shifts = places.join(by_shift, [*pair, "shift"], "left")
    shifts = shifts.withColumn("far", F.coalesce((F.col("shift") - F.lag("shift").over(along) > F.col("size")).cast("long"), F.lit(0)))
    shifts = shifts.withColumn("run", F.sum("far").over(along))
    kinds = [F.struct(F.lit(i).alias("kind"), c.cast("long").alias("number")) for i, c in enumerate([F.col("shift"), F.col("run"), F.lit(0)])]
    grouped = shifts.withColumn("alignment", F.explode(F.array(*kinds))).groupBy(*pair, "words", "size", "alignment").agg(
        F.flatten(F.collect_list("places")).alias("places"), (F.sum("good") / F.sum("n")).alias("consistency"), F.max("changed").alias("changed"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1)))))
    return grouped.select(*pair, (covered / F.col("words")).alias("coverage"), F.coalesce("consistency", F.lit(1.0)).alias("consistency"),
                          F.coalesce("changed", F.lit(False)).alias("changed"))


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, coverage, consistency, reparameterised``: the items found in each row's text.

    Rows without a find do not appear; repeated rows appear each; a null id stays null; other
    columns are ignored; an empty table on either side gives no rows.
    """
    pairs = stored(contaminated(docs, benchmark, **options), "decontam-found")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.encode(F.col("text").cast("string"), "utf-8")).alias("digest"))
    return rows.join(pairs, "digest").select("doc_id", "item_id", "coverage", "consistency", "reparameterised")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; null texts stay."""
    found = stored(contaminated(docs, benchmark, **options).select(F.col("digest").alias("__leak")).distinct(), "decontam-texts")
    return docs.join(found, F.md5(F.encode(docs["text"].cast("string"), "utf-8")) == found["__leak"], "left_anti")
