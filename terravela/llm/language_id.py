"""Language ID: script ranges narrow the candidates of a word, then Viterbi over per-word scores labels spans.

A word's score for a language is the clipped log-likelihood ratio of its byte trigrams. The Viterbi path pays
a penalty for each switch, so that a lone odd word doesn't open a span. Long texts are cut into blocks whose
transfer matrices are computed side by side and then chained, which gives the exact path over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravela.llm import textbytes as tb

#: First and last code points of scripts.
SCRIPT_RANGES = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
SCRIPTS = ["other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]
BUCKETS = 1 << 17
#: Documents per language that fit_language_model reads at most, about.
SAMPLE_PER_LANG = 600
BLOCK = 128
#: Bytes of text that are labelled at a time for up to eight languages; fewer for more, as matrices grow with their square.
LABEL_BYTES = 1 << 20

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[0x80:] = False
_SEPARATOR[0x41:0x5B] = _SEPARATOR[0x61:0x7B] = False
_tables: list[np.ndarray] = []


def _unicode_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its script."""
    if not _tables:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        script = np.zeros(0x110000, np.uint8)
        for name, first, last in SCRIPT_RANGES:
            script[first : last + 1] = SCRIPTS.index(name)
        _tables.extend([letter, script])
    return _tables[0], _tables[1]


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # scripts x languages: may the language be written in it
    penalty: float = 8.0
    clip: float = 6.0


def _trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each word between two spaces, and where each word's begin."""
    length = end - start
    at = np.concatenate([[0], np.cumsum(length + 2)])
    padded = np.full(at[-1], 0x20, np.int64)
    inner = np.repeat(at[:-1] + 1 - (np.cumsum(length) - length), length) + np.arange(length.sum())
    padded[inner] = data[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())]
    tri = (padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]) if len(padded) > 2 else np.zeros(0, np.int64)
    tri = (tri * 0x9E3779B1 >> 7) & (BUCKETS - 1)
    return tri[inner - 1], np.cumsum(length) - length


def _letters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: has it a letter, and the script of its first one."""
    letter, script = _unicode_tables()
    found, kind = np.zeros(len(start), bool), np.zeros(len(start), np.uint8)
    plain = data[start] < 0x80
    found[plain], kind[plain] = True, SCRIPTS.index("latin")
    raw = data.tobytes()
    for i in np.flatnonzero(~plain).tolist():
        for c in raw[start[i] : end[i]].decode("utf-8", "replace"):
            if letter[ord(c)]:
                found[i], kind[i] = True, script[ord(c)]
                break
    return found, kind


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, feature, n) of each batch's texts: trigram buckets, and scripts as BUCKETS + their number."""
    for batch in batches:
        for part in tb.slices(batch, "text"):
            names = pa.compute.dictionary_encode(part.column(1))
            data, offsets = tb.utf8(part.column(0))
            data = tb.lower_ascii(data)
            start, end, row = tb.words(data, offsets, _SEPARATOR)
            lang = names.indices.to_numpy()[row].astype(np.int64)
            tri, _ = _trigrams(data, start, end)
            key = np.concatenate([np.repeat(lang, end - start) * 2 * BUCKETS + tri, lang * 2 * BUCKETS + BUCKETS + _letters(data, start, end)[1]])
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(key // (2 * BUCKETS))), pa.array(key % (2 * BUCKETS)), pa.array(n)], ["lang", "feature", "n"])


def fit_language_model(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG, id_col: str = "doc_id") -> LanguageModel:
    """From rows (text, lang), of which the per_lang of each language that come first by hash are counted in tasks.

    The hash is of the text and, if there is such a column, the id, so that copies enter one by one and equal rows are
    interchangeable. Only the counts, at most BUCKETS and the scripts of each language, reach the driver. Rows with a null
    text or lang are left out. Without any row the model has no language and labels all `und`.
    """
    drawn = [F.col(id_col)] if id_col in labelled.columns else []
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64("text", *drawn).alias("draw"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    # Twice the rows wanted, so that only a bounded number is ranked.
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, 2 * per_lang / counts[lang]))])
    sample = labelled.where(F.pmod("draw", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 20)), "draw", "text"))
    sample = sample.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("text", "lang")
    found = sample.mapInArrow(_count_features, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    table, scripts = np.full((BUCKETS, len(langs)), 0.05), np.zeros((len(SCRIPTS), len(langs)))
    of = np.array([langs.index(x) for x in found.column("lang").to_pylist()], np.int64)
    feature, n = found.column("feature").to_numpy(), found.column("n").to_numpy()
    tri = feature < BUCKETS
    table[feature[tri], of[tri]] += n[tri]
    scripts[feature[~tri] - BUCKETS, of[~tri]] += n[~tri]
    log = np.log(table / table.sum(0))
    return LanguageModel(langs, (log - log.mean(1, keepdims=True)).astype(np.float32), scripts >= 0.01 * scripts.sum(0))


def _best_path(score: np.ndarray, begin: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word; rows of score from begin[d] to begin[d + 1] are a document."""
    n, states = np.diff(begin), score.shape[1]
    blocks = -(-n // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(first[-1])
    if not total:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(n)), blocks)
    inner = np.arange(total) - first[doc]
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(score)) - begin[row]
    padded = np.zeros((BLOCK, total, states), np.float32)
    padded[offset % BLOCK, first[row] + offset // BLOCK] = score

    v = np.full((total, states, states), -np.inf, np.float32)
    v[:, np.arange(states), np.arange(states)] = 0
    for t in range(BLOCK):
        v = padded[t][:, None, :] + np.maximum(v, v.max(2, keepdims=True) - penalty)
    entry = np.zeros((total, states), np.float32)
    order = np.argsort(inner, kind="stable")
    level = np.concatenate([[0], np.cumsum(np.bincount(inner))])
    for k in range(1, len(level) - 1):
        b = order[level[k] : level[k + 1]]
        entry[b] = (entry[b - 1][:, :, None] + v[b - 1]).max(1)
        entry[b] -= entry[b].max(1, keepdims=True)

    number = np.int8 if states < 128 else np.int32
    came = np.empty((BLOCK, total, states), number)
    own, now = np.arange(states, dtype=number), entry
    for t in range(BLOCK):
        top = now.argmax(1)
        jump = now[np.arange(total), top][:, None] - penalty
        came[t] = np.where(now >= jump, own, top[:, None].astype(number))
        now = padded[t] + np.maximum(now, jump)
    ends = now.argmax(1)
    source = np.tile(own, (total, 1))
    for t in range(BLOCK - 1, -1, -1):
        source = np.take_along_axis(came[t], source.astype(np.int64), 1)
    for k in range(len(level) - 2, 0, -1):
        b = order[level[k] : level[k + 1]]
        ends[b - 1] = source[b, ends[b]]
    path = np.empty((BLOCK, total), number)
    for t in range(BLOCK - 1, -1, -1):
        path[t] = ends
        ends = came[t][np.arange(total), ends].astype(np.int64)
    return path[offset % BLOCK, first[row] + offset // BLOCK].astype(np.int64)


def _label(model: LanguageModel, part: pa.RecordBatch) -> pa.RecordBatch:
    rows, states = part.num_rows, len(model.langs)
    data, offsets = tb.utf8(part.column(1))
    low = tb.lower_ascii(data)
    start, end, row = tb.words(low, offsets, _SEPARATOR)
    _, first, inverse = np.unique(tb.word_hashes(low, start, end), return_index=True, return_inverse=True)
    has, script = _letters(low, start[first], end[first])
    tri, at = _trigrams(low, start[first], end[first])
    if states and len(first):
        score = np.add.reduceat(model.weights[tri], at, axis=0)
        allowed = model.scripts[script]
        score = np.where(allowed | ~allowed.any(1, keepdims=True), score, -np.inf)
        score = np.maximum(score - score.max(1, keepdims=True), -model.clip) * has[:, None]
    else:
        score, has = np.zeros((len(first), states), np.float32), has & bool(states)
    keep = has[inverse]
    row, inverse = row[keep], inverse[keep]
    n = np.bincount(row, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(n)])
    path = _best_path(score[inverse], begin, model.penalty) if states else np.zeros(0, np.int64)
    tally = np.bincount(row * max(states, 1) + path, minlength=rows * max(states, 1)).reshape(rows, -1)
    best = tally.argmax(1)
    known = n > 0
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
    spans = np.flatnonzero(new)
    stop = np.append(spans[1:], len(path))
    names = pa.array([*model.langs, "und"])
    of_doc = np.concatenate([[0], np.cumsum(np.bincount(row[spans], minlength=rows))]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(spans - begin[row[spans]], pa.int32()), pa.array(stop - begin[row[spans]], pa.int32()), names.take(pa.array(path[spans]))], ["first_word", "end_word", "lang"])
    return pa.RecordBatch.from_arrays(
        [part.column(0), names.take(pa.array(np.where(known, best, states))), pa.array(np.where(known, tally[np.arange(rows), best] / np.maximum(n, 1), 0.0)), pa.ListArray.from_arrays(pa.array(of_doc), items)],
        ["doc_id", "lang_pred", "score", "spans"],
    )


def _label_bytes(model: LanguageModel) -> int:
    return max(1 << 12, LABEL_BYTES * 64 // max(8, len(model.langs)) ** 2)


def label_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans), one row for each input row.

    Words are runs of letters and of non-ASCII characters; those without a letter belong to no span. spans are
    runs of words with one label; lang_pred is the label of most words, score its share. A text that is null,
    empty or without a letter is `und` with score 0. Ids may have any type, be null or repeat; other columns are ignored.
    Arrow batches of the session are held to a few thousand rows from here on (short_batches).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch, "text", _label_bytes(shared.value)):
                yield _label(shared.value, part)

    out = f"doc_id {tb.type_of(docs, id_col)}, lang_pred string, score double, spans array<struct<first_word:int,end_word:int,lang:string>>"
    return tb.short_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def filter_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", least_share: float = 0.4) -> DataFrame:
    """docs of which some language holds least_share of the words or more; all columns stay.

    Rejects texts that are null, empty or without a letter, and patchworks without a main language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(place)], ["row", "text"])
            at = 0
            for part in tb.slices(texts, "text", _label_bytes(shared.value)):
                found = _label(shared.value, part)
                keep = [lang != "und" and share >= least_share for lang, share in zip(found.column(1).to_pylist(), found.column(2).to_pylist())]
                yield batch.slice(at, part.num_rows).filter(pa.array(keep, pa.bool_()))
                at += part.num_rows

    return tb.short_batches(docs).mapInArrow(run, docs.schema)
