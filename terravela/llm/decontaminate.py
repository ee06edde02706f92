"""Benchmark decontamination in DataFrame functions: spaced-seed hashes, then substitution-tolerant overlaps.

A seed hashes the words of a window that a mask selects, so that a substituted word in an ignored place
changes nothing. Test items are hashed at every place, documents at every `stride`-th one (1: at every place, so that
an item of as many words as a mask spans can't be missed). Around each hit the diagonal is scored, +1 for an equal word and -2 for a
substituted one, and the best stretch decides, or the share of the item's words that the diagonal holds. For that share an item of
which s words may differ is cut into s + 1 parts, of which one is unchanged; the first words of each part are seeds too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravela.plans.lineage import broadcast_below, cut

#: Masks over nine words; 1 selects a word.
MASKS = ("110100111", "111010011", "101101101")
#: Test words whose seeds may be broadcast, about 15 MB; beyond that seeds and hits are joined by shuffles.
BROADCAST_WORDS = 100_000


def word_array(text: Column) -> Column:
    """Lower-case runs of letters and digits as 64-bit hashes; all of a text, an empty array for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _may_differ(n: int) -> int:
    """Words of n that may differ when 0.8 of them are equal."""
    return n // 5


def _gram(span: int) -> int:
    """Words that each part of an item of span words or more has."""
    return min(n // (_may_differ(n) + 1) for n in range(span, span + 50))


def _part_length(n: int, span: int) -> int:
    """Words hashed of each part of an item of n words: the shortest part of any item as long as a mask, or the item's own."""
    return _gram(span) if n >= span else n // (_may_differ(n) + 1)


def _seeds(words: DataFrame, stride: int, masks: tuple[str, ...], lengths: list[int], parts: bool = False) -> DataFrame:
    """words(..., w array<long>) -> a row for each window and mask, and for each place and part length (parts: each part's beginning): (..., at, seed)."""
    span, at, n = len(masks[0]), F.col("at"), F.size("w")
    # An outer explode, as the optimiser would filter by the array's size for a plain one and so split the text twice.
    windows = words.withColumn("at", F.explode_outer(F.when(n >= min(lengths), F.sequence(F.lit(0), n - min(lengths))))).where("at IS NOT NULL")
    hashes = [F.when((at % stride == 0) & (at <= n - span), F.xxhash64(F.lit(k), *[F.get("w", at + i) for i, bit in enumerate(mask) if bit == "1"])) for k, mask in enumerate(masks)]
    for length in lengths:
        part = F.when(at <= n - length, F.xxhash64(F.lit(len(masks)), F.lit(length), *[F.get("w", at + i) for i in range(length)]))
        if parts:
            own = [k for k in range(1, span) if _part_length(k, span) == length]
            n_parts = F.floor(n / 5) + 1
            begins = F.array_contains(F.transform(F.sequence(F.lit(0), n_parts - 1), lambda i: F.floor(i * n / n_parts)), at.cast("long"))
            part = F.when((n.isin(own) | ((n >= span) & F.lit(length == _gram(span)))) & begins, part)
        hashes.append(part)
    return windows.withColumn("seed", F.explode(F.array(*hashes))).where("seed IS NOT NULL")


def _best_stretch(part: Column, item: Column, shift: Column) -> Column:
    """Best-scoring stretch of the diagonal on which item[k] meets word k + shift of a document, part its words from shift on: score, first and end (in the document), equal words; all equal words of the diagonal."""
    low = F.greatest(F.lit(0), -shift)
    high = low + F.least(F.size(part), F.size(item) - low) - 1
    start = F.struct(*[F.lit(0).alias(x) for x in ("now", "since", "equal", "score", "first", "end", "same", "all")])

    def step(a, k):
        equal = F.get(item, k) == F.get(part, k - low)
        fresh = a["now"] <= 0
        now = F.when(fresh, 0).otherwise(a["now"]) + F.when(equal, 1).otherwise(-2)
        since = F.when(fresh, k + shift).otherwise(a["since"])
        n = F.when(fresh, 0).otherwise(a["equal"]) + equal.cast("int")
        better = now > a["score"]
        return F.struct(now.alias("now"), since.alias("since"), n.alias("equal"), F.when(better, now).otherwise(a["score"]).alias("score"), F.when(better, since).otherwise(a["first"]).alias("first"), F.when(better, k + shift + 1).otherwise(a["end"]).alias("end"), F.when(better, n).otherwise(a["same"]).alias("same"), (a["all"] + equal.cast("int")).alias("all"))

    return F.aggregate(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), start, step)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, stride: int = 1, least_score: int = 12, least_words: int = 1) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word, same_words): documents that hold a passage of a test item.

    A row for each pair whose best stretch scores least_score, or 0.8 of the item's words if that is less, and for
    each pair of which 0.8 of the item's words are equal at their places, whatever they score; the columns tell of
    the best stretch. Of items of fewer than five words all must be equal. Every item with a word is searched for, or with
    least_words only those of so many words; null and empty texts match nothing. Rows of docs or benchmark with equal or null
    ids are judged one by one and reported once. Ids may have any type; other columns are ignored.
    """
    span = len(masks[0])
    items = benchmark.select(F.col(item_col).alias("item_id"), word_array(F.col(item_text_col)).alias("item")).where(F.size("item") >= max(1, least_words))
    items = cut(items.withColumn("item_key", F.monotonically_increasing_id()))
    facts = items.agg(F.sum(F.size("item")).alias("words"), F.collect_set(F.least(F.size("item"), F.lit(span))).alias("sizes")).first()  # span sizes at most
    lengths = sorted({_part_length(n, span) for n in facts["sizes"]}) or [_gram(span)]
    index = _seeds(items.withColumnRenamed("item", "w"), 1, masks, lengths, parts=True).select("seed", "item_key", F.col("at").alias("item_at"))
    words = docs.select(F.col(id_col).alias("doc_id"), word_array(F.col(text_col)).alias("w"))
    shift = F.col("at") - F.col("item_at")
    small = (facts["words"] or 0) <= BROADCAST_WORDS
    if small:
        hits = _seeds(words, stride, masks, lengths).join(F.broadcast(index), "seed").join(F.broadcast(items), "item_key").withColumn("shift", shift)
    else:
        keyed = words.withColumn("key", F.xxhash64("w"))
        found = _seeds(keyed, stride, masks, lengths).select("doc_id", "key", "at", "seed").join(index, "seed").select("doc_id", "key", "item_key", shift.alias("shift")).distinct()
        same = keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["key"] == F.col("_key"))
        found = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "item_key", "shift")
        hits = found.join(keyed.dropDuplicates(["doc_id", "key"]), same).join(items, "item_key")
    # A diagonal is scored once, however many seeds hit it, and only its own words travel.
    part = F.slice("w", F.greatest(F.lit(0), F.col("shift")) + 1, F.size("item") + F.least(F.lit(0), F.col("shift")))
    diagonals = hits.select("doc_id", "item_key", "shift", part.alias("part")).distinct()
    hits = diagonals.join(F.broadcast(items) if small else items, "item_key")
    best = _best_stretch(F.col("part"), F.col("item"), F.col("shift"))
    need = F.least(F.lit(least_score), F.floor(F.size("item") * 0.8).cast("int"))
    share = F.size("item") - F.floor(F.size("item") / 5)
    scored = hits.select("doc_id", "item_id", best.alias("best"), need.alias("need"), share.alias("share")).where((F.col("best.score") >= F.col("need")) | (F.col("best.all") >= F.col("share")))
    top = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("best.score", (-F.col("best.first")).alias("back"), "best.end", "best.same")).alias("top"))
    return top.select("doc_id", "item_id", F.col("top.score").alias("score"), (-F.col("top.back")).alias("first_word"), F.col("top.end").alias("end_word"), F.col("top.same").alias("same_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that hold a passage of a test item; all columns stay. Rows without an id stay."""
    gone = cut(contaminated(docs, benchmark, id_col, text_col, **options).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct())
    gone = broadcast_below(gone, 250_000)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
