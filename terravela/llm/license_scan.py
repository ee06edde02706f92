"""License scans: exact seeds locate candidates for short notices, and bounded-error matching verifies them.

A phrase that may have e errors is split into e + 1 pieces, one of which any match holds unchanged. Only
around such a seed does the regex library look for the phrase with at most e errors.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravela.llm import textbytes as tb


@dataclass(frozen=True)
class Notice:
    phrase: str  # words parted by single spaces
    label: str
    errors: int = 0


#: The base notices, whose exact places are counted. Phrases too short to tell from other words have no errors.
NOTICES = (
    Notice("gnu general public license", "gpl", 3),
    Notice("apache license", "apache", 2),
    Notice("cc by", "cc-by", 0),
    Notice("mit license", "mit", 1),
)
#: Further notices, licences by their names or by the words that open them, and reservations of rights.
FURTHER = (
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("boost software license", "boost", 2),
    Notice("bsd license", "bsd", 1),
    Notice("bsd 2 clause", "bsd", 1),
    Notice("bsd 3 clause", "bsd", 1),
    Notice("redistribution and use in source and binary forms", "bsd", 5),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("isc license", "isc", 0),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 6),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("cc by sa", "cc-by-sa", 0),
    Notice("cc by nc", "cc-by-nc", 0),
    Notice("cc by nd", "cc-by-nd", 0),
    Notice("cc0", "cc0", 0),
    Notice("public domain dedication", "public-domain", 2),
    Notice("spdx license identifier", "spdx", 2),
    Notice("all rights reserved", "reserved", 2),
)
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[0x30:0x3A] = _SEPARATOR[0x61:0x7B] = False
_SEPARATOR[0x80:] = False


def seeds(phrase: str, errors: int) -> list[tuple[int, str]]:
    """Pieces of about equal length with their places in the phrase."""
    cuts = [round(i * len(phrase) / (errors + 1)) for i in range(errors + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        self.exact = [f" {n.phrase} ".encode() for n in notices]
        self.fuzzy = [(i, n, [(at, s.encode()) for at, s in seeds(n.phrase, n.errors)], regex.compile(rf"(?e)(?:{regex.escape(n.phrase)}){{e<={n.errors}}}")) for i, n in enumerate(notices) if n.errors]

    def scan(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(first byte, end byte, notice, errors) in normalised text: words parted, led and followed by one space."""
        found = []
        for i, needle in enumerate(self.exact):
            at = text.find(needle)
            while at >= 0:
                found.append((at + 1, at + len(needle) - 1, i, 0))
                at = text.find(needle, at + 1)
        exact = {(a, i) for a, _, i, _ in found}
        for i, notice, pieces, pattern in self.fuzzy:
            windows = []
            for offset, piece in pieces:
                at = text.find(piece)
                while at >= 0:
                    # An added character has up to four bytes; the search needs a character before the match.
                    windows.append((max(0, at - offset - 4 * notice.errors - 2), at - offset + len(notice.phrase) + 4 * notice.errors + 2))
                    at = text.find(piece, at + 1)
            windows.sort()
            merged: list[list[int]] = []
            for a, b in windows:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                while a and text[a] & 0xC0 == 0x80:
                    a -= 1
                while b < len(text) and text[b] & 0xC0 == 0x80:
                    b += 1
                found += [(s, e, i, n) for s, e, n in self._verify(text, a, b, notice, pattern) if not any((k, i) in exact for k in range(s, e))]
        return sorted(set(found))

    @staticmethod
    def _verify(text: bytes, a: int, b: int, notice: Notice, pattern: regex.Pattern) -> list[tuple[int, int, int]]:
        """The best runs of whole words in a window that match with errors, none overlapping another."""
        starts = [k for k in range(max(a, 1), min(b, len(text))) if text[k] != 32 and text[k - 1] == 32]
        ends = [k for k in range(a + 1, min(b, len(text) - 1) + 1) if text[k] == 32 and text[k - 1] != 32]
        runs, least, most = [], len(notice.phrase) - notice.errors, len(notice.phrase) + notice.errors
        for s in starts:
            # A run of `least` characters has as many bytes or more.
            for k in range(bisect_left(ends, s + max(least, 1)), len(ends)):
                e = ends[k]
                run = text[s:e].decode("utf-8", "replace")
                if len(run) > most:
                    break
                if len(run) >= least and (m := pattern.fullmatch(run)):
                    runs.append((sum(m.fuzzy_counts), s, e))
        best: list[tuple[int, int, int]] = []
        for n, s, e in sorted(runs):
            # Runs kept don't overlap, so that only their neighbours by place can meet this one.
            at = bisect_left(best, (s, e, n))
            if n and (not at or best[at - 1][1] <= s) and (at == len(best) or best[at][0] >= e):
                best.insert(at, (s, e, n))
        return best


def _normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's words led, parted and followed by one space, the rows' offsets, and the rows' word counts."""
    start, end, row = tb.words(data, offsets, _SEPARATOR)
    n = np.bincount(row, minlength=len(offsets) - 1)
    length = end - start
    bytes_of = np.bincount(row, weights=length + 1, minlength=len(n)).astype(np.int64) + 1
    at = np.concatenate([[0], np.cumsum(bytes_of)])
    before = np.cumsum(length + 1) - (length + 1)
    out = np.full(at[-1], 0x20, np.uint8)
    flat = np.arange(int(length.sum()))
    skip = np.cumsum(length) - length
    out[np.repeat(before + row + 1 - skip, length) + flat] = data[np.repeat(start - skip, length) + flat]
    return out, at, n


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES + FURTHER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans), one row for each input row, over whole texts.

    A-Z is lower-cased; words are runs of a-z, 0-9 and non-ASCII characters. spans are (label, phrase, first_word,
    n_words, errors, similarity) in order of place, with 0 errors for a phrase whose words stand consecutively, else
    the edits of the best match that begins and ends at words. A null or empty text has no words or
    spans. Ids may have any type, be null or repeat; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            for part in tb.slices(batch, "text"):
                data, offsets = tb.utf8(part.column(1))
                text, at, n = _normalise(tb.lower_ascii(data), offsets)
                raw, space = text.tobytes(), np.flatnonzero(text == 0x20)
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                # Rows meet at two spaces, which no phrase holds; a match with an error there is no word's end.
                for start, end, i, errors in scanner.scan(raw):
                    d = int(np.searchsorted(at, start, side="right")) - 1
                    if end >= at[d + 1]:
                        continue
                    notice = scanner.notices[i]
                    row, first, last = np.searchsorted(space, [at[d], start, end]).tolist()
                    spans[d].append({"label": notice.label, "phrase": notice.phrase, "first_word": first - row - 1, "n_words": last - first + 1, "errors": errors, "similarity": 1 - errors / len(notice.phrase)})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(spans, kind)], ["doc_id", "n_words", "spans"])

    out = f"doc_id {tb.type_of(docs, id_col)}, n_words long, spans array<struct<label:string,phrase:string,first_word:long,n_words:long,errors:int,similarity:double>>"
    return tb.short_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def summarise(scanned: DataFrame, base: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Per document, the exact places of the base notices, the labels of all spans, and how many spans have errors.

    score is the best similarity of a span, 0 without one.
    """
    exact = F.filter("spans", lambda s: (s["errors"] == 0) & s["phrase"].isin([n.phrase for n in base]))
    fuzzy = F.filter("spans", lambda s: s["errors"] > 0)
    first, label = (lambda s: s["first_word"]), (lambda s: s["label"])
    return scanned.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(F.transform(exact, first)).alias("first_word"), F.array_max(F.transform(exact, first)).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(exact, label))), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.transform("spans", label))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"), F.size(fuzzy).cast("long").alias("n_fuzzy"),
    )
