"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding undoes homoglyphs and digit substitutions. Lexicon entries are whole words or word beginnings;
matches inside an exception phrase don't count.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravela.llm import textbytes as tb
from terravela.plans.lineage import cut

#: Letters of other scripts, signs and digits that stand in for Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "д": "d", "ԁ": "d", "ɡ": "g",
    "А": "a", "Е": "e", "О": "o", "Р": "p", "С": "c", "У": "y", "Х": "x", "І": "i", "Ј": "j", "Ѕ": "s", "К": "k", "М": "m", "Т": "t", "В": "b", "Н": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "Α": "a", "Β": "b", "Ε": "e", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x", "Ζ": "z",
}
#: Digits that stand in for letters, but only in a run that holds a letter, so that numbers stay numbers.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
#: Signs that stand in for letters, but only before a letter (! and | only between two).
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
#: Zero-width characters and the soft hyphen, which split words invisibly.
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a word that may be in the lexicon is harmless; fit_lexicon learns more from the labels.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "soap scum", "sore loser clause", "worthless currency")


_FULLWIDTH = {0xFF01 + i: 0x21 + i for i in range(94)}
_FOLD = {k: ord(LOOKALIKES.get(chr(v), chr(v).lower())) for k, v in _FULLWIDTH.items()} | {ord(c): ord(c) + 32 for c in map(chr, range(0x41, 0x5B))} | {ord(k): ord(v) for k, v in LOOKALIKES.items()} | dict.fromkeys(map(ord, INVISIBLE))
_SIGN = re.compile(r"[@$](?=[^\W\d_])|(?<=[^\W\d_])[!|](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<![^\W_])[^\W\d_]*+\d[^\W_]*+")  # a run with a digit; linear in the text
_DIGITS = str.maketrans(DIGITS)


def fold(text: str) -> str:
    """Lower case, without look-alikes: digits beside letters and signs count as the letters they stand for."""
    plain = _MIXED.sub(lambda m: m[0].translate(_DIGITS) if _WORD.search(m[0]) else m[0], text.translate(_FOLD).lower())
    return _SIGN.sub(lambda m: SIGNS[m[0]], plain)


@dataclass
class Lexicon:
    weights: dict[str, float]  # a word, or a word's beginning with a trailing *
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: float = 1.0  # the normalised weight at which the score is `at`
    at: float = 0.7
    _automaton: object = field(default=None, repr=False)

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                stem = entry.rstrip("*")
                whole = not entry.endswith("*")
                old = a.get(stem, None)
                a.add_word(stem, (len(stem), weight if whole else (old or (0, 0.0, 0.0))[1], weight if not whole else (old or (0, 0.0, 0.0))[2]))
            for phrase in map(fold, self.exceptions):
                a.add_word(f"{phrase}", (len(phrase), None, None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def weigh(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The summed weight and its spans (start, end, weight) in the folded text; each word counts once, by its best entry."""
        a = self.automaton()
        if not len(a) or not text:
            return 0.0, []
        folded = fold(text)
        hits, safe = {}, []
        for last, (n, whole, begins) in a.iter(folded):
            start, end = last + 1 - n, last + 1
            if start and folded[start - 1].isalpha():
                continue
            ends = end == len(folded) or not folded[end].isalpha()
            if whole is None:
                if ends:
                    safe.append((start, end))
                continue
            weight = max(whole if ends else 0.0, begins)
            if weight and weight > hits.get(start, (0, 0.0))[1]:
                hits[start] = (end, weight)
        spans = [(s, e, w) for s, (e, w) in hits.items() if not any(p <= s and e <= q for p, q in safe)]
        return sum(w for _, _, w in spans), spans

    def normalised(self, weight: float, n_chars: int) -> float:
        """Weight per length: a text twice as long needs more, but less than twice, for the same score."""
        return weight / (1.0 + math.log1p(n_chars / 4000.0)) if weight else 0.0

    def score(self, text: str) -> float:
        x = self.normalised(self.weigh(text)[0], len(text))
        return x / (x + self.scale * (1 - self.at) / self.at)


def _features(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return words | {f"{w[:n]}*" for w in words for n in (4, 5, 6, 7) if len(w) > n}


def _counted(features):
    """(feature, toxic, clean): in how many texts of either label features(text) holds a feature, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch, "text"):
                toxic, clean = Counter(), Counter()
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    (toxic if label else clean).update(features(text))
                names = list(toxic | clean)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], ["feature", "toxic", "clean"])

    return run


def _counts(sample: DataFrame, features) -> DataFrame:
    return sample.mapInArrow(_counted(features), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _surely_toxic(counts: DataFrame, n_toxic: int, n_clean: int, least: float, alpha: float) -> DataFrame:
    """The rows of counts(feature, toxic, clean) whose features mark toxic texts, with their ratio.

    Such a feature is `least` times likelier in toxic texts, and its divergence from the sample's share of toxic texts
    (Chernoff's bound of the binomial tail) passes the log of the features tried over alpha: with labels dealt by
    chance, less than a share alpha of tables would have any such feature.
    """
    tried = counts.count()
    share, seen = n_toxic / (n_toxic + n_clean), F.col("toxic") + F.col("clean")
    p = F.col("toxic") / seen
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    evidence = seen * (part(p, F.lit(share)) + part(1 - p, F.lit(1 - share)))
    ratio = (F.col("toxic") + 0.1) / n_toxic / ((F.col("clean") + 0.5) / n_clean)
    return counts.withColumn("ratio", ratio).where((p > share) & (F.col("ratio") >= least) & (evidence >= math.log(max(tried, 1) / alpha)))


_NEXT, _BEFORE = re.compile(r" [^\W\d_]+"), re.compile(r"[^\W\d_]+ \Z")


def _phrases(lexicon: Lexicon):
    """The two-word phrases of a text in which a lexicon word stands."""

    def run(text: str) -> set[str]:
        folded, out = fold(text), set()
        for start, end, _ in lexicon.weigh(text)[1]:
            tail = _WORD.match(folded, end)  # the rest of a word of which only the beginning is in the lexicon
            end = tail.end() if tail else end
            if after := _NEXT.match(folded, end):
                out.add(folded[start : after.end()])
            line = folded[max(0, start - 60) : start]
            if before := _BEFORE.search(line):
                out.add(before[0] + folded[start:end])
        return out

    return run


def fit_lexicon(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, min_docs: int = 4, least: float = 1.5, alpha: float = 0.01) -> Lexicon:
    """From docs(doc_id, text) and labels(doc_id, toxic 0/1), of which the max_docs of each label that come first by hash are read.

    The sample is drawn from the labels, so that only its few ids (2 * max_docs) meet the documents. Tried are words
    and beginnings in min_docs texts or more, whatever their labels. An entry is surely likelier in toxic texts, by a bound
    corrected for the number tried (alpha), and at least `least` times; its weight is the log of that ratio. A phrase of
    an entry and the word before or after it is an exception if it occurs in min_docs clean texts or more and is
    likelier there. The scale is the normalised weight that best parts the sample's labels. What reaches the driver, entries,
    phrases and weights, is bounded by the sample. Rows with a null id, text or label are
    left out; without both labels the lexicon is empty and every score 0.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    first = [labels.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for k in (0, 1)]
    chosen_ids = cut(first[0].unionByName(first[1]))
    # A bounded sample needs few partitions.
    sample = cut(docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen_ids), "doc_id").select("text", "toxic").repartition(8))
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({})
    tried = cut(_counts(sample, _features).where(F.col("toxic") + F.col("clean") >= min_docs))
    chosen = _surely_toxic(tried, n_toxic, n_clean, least, alpha).collect()
    lexicon_of = {r["feature"]: (r["toxic"], math.log(r["ratio"])) for r in chosen}
    names = sorted(lexicon_of)
    weights = {x: w for x, (_, w) in lexicon_of.items()}
    for entry in sorted((x for x in names if x.endswith("*")), key=lambda x: (-len(x), x)):
        stem, count = entry[:-1], lexicon_of[entry][0]
        longer = [x for x in names[bisect_left(names, stem) : bisect_left(names, stem + "\U0010ffff")] if x in weights and len(x.rstrip("*")) > len(stem)]
        if longer and max(lexicon_of[x][0] for x in longer) >= 0.9 * count:
            del weights[entry]  # one word makes up the beginning: the word tells more
        elif len(longer) > 1:
            for x in longer:
                if lexicon_of[x][1] <= lexicon_of[entry][1]:
                    del weights[x]
    harmless = _counts(sample, _phrases(Lexicon(weights, ()))).where((F.col("clean") >= min_docs) & (F.col("clean") * n_toxic > F.col("toxic") * n_clean)).collect()
    lexicon = Lexicon(weights, EXCEPTIONS + tuple(sorted(r["feature"] for r in harmless)))
    scored = sample.mapInArrow(_weigh(lexicon), "x double, toxic int").groupBy("x").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    points = sorted(((r["x"], r["toxic"], r["n"]) for r in scored.collect()), reverse=True)
    best, scale, right, taken = -1.0, 1.0, 0, 0
    for i, (x, toxic, n) in enumerate(points):
        if x <= 0:
            break
        right, taken = right + toxic, taken + n
        below = points[i + 1][0] if i + 1 < len(points) else 0.0
        if (f1 := 2 * right / (taken + n_toxic)) > best:
            best, scale = f1, (x + below) / 2
    lexicon.scale = scale
    return lexicon


def _weigh(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch, "text"):
                x = [round(lexicon.normalised(lexicon.weigh(t)[0], len(t)), 4) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), part.column(1)], ["x", "toxic"])

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, n_matches, matches), one row for each input row, over whole texts.

    score is in [0, 1), 0 for a text that is null, empty or without a lexicon word; predicted is 1 at threshold
    or more. matches are spans (start, end, weight) in the folded text. Ids may have any type, be null or repeat; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by its sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in tb.slices(batch, "text"):
                # Spans lie in flat arrays: a text in which every word counts has as many spans as words.
                scores, ends_at, starts, ends, weights = [], array("i", [0]), array("i"), array("i"), array("d")
                for text in part.column(1).to_pylist():
                    weight, hits = own.weigh(text or "")
                    x = own.normalised(weight, len(text or ""))
                    scores.append(x / (x + own.scale * (1 - own.at) / own.at))
                    for s, e, w in hits:
                        starts.append(s)
                        ends.append(e)
                        weights.append(w)
                    ends_at.append(len(starts))
                places = [pa.array(np.frombuffer(x, np.int32)) if len(x) else pa.array([], pa.int32()) for x in (ends_at, starts, ends)]
                spans = pa.StructArray.from_arrays([places[1], places[2], pa.array(np.frombuffer(weights, np.float64)) if len(weights) else pa.array([], pa.float64())], ["start", "end", "weight"])
                counts = np.diff(np.frombuffer(ends_at, np.int32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(counts), pa.ListArray.from_arrays(places[0], spans)], ["doc_id", "score", "predicted", "n_matches", "matches"])

    out = f"doc_id {tb.type_of(docs, id_col)}, score double, predicted int, n_matches long, matches array<struct<start:int,end:int,weight:double>>"
    return tb.short_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)
