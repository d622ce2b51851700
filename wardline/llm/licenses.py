"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms them.

The runs of words of each template are hashed and winnowed, and an inverted index leads
from a hash to its templates and places. All runs of a document are looked up; the diagonal of
a hit is a candidate place, where a banded local alignment
counts the template's words that are met in order and gives the matched span.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import combine, hash_words, pieces
from .license_texts import TEMPLATES

RUN, WINNOW, BAND, LEAST_COVERAGE = 3, 4, 8, 0.8
#: All templates together; they go to every task.
MOST_TEMPLATE_BYTES = 16_000_000
_WORDS = bytes(32 if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def words_of(text: bytes) -> Words:
    """Letters and digits between ASCII signs and blanks, in lower case; places are bytes of the text."""
    plain = text.translate(_WORDS)
    edge = np.diff((np.frombuffer(b" " + plain + b" ", np.uint8) != 32).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(starts, ends, hash_words(plain, starts, ends - starts))


def runs_of(hashes: np.ndarray) -> np.ndarray:
    """Hash of each run of RUN words."""
    n = max(0, len(hashes) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for i in range(RUN):
        out = combine(out, hashes[i : i + n])
    return out


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the least hash, the last of equals, of every WINNOW in a row."""
    if len(hashes) <= WINNOW:
        return np.arange(len(hashes))
    rows = np.lib.stride_tricks.sliding_window_view(hashes, WINNOW)[:, ::-1]
    return np.unique(np.arange(len(rows)) + WINNOW - 1 - rows.argmin(axis=1))


class Index:
    """From hashes of word runs to (template, place)."""

    def __init__(self, templates: dict[str, str]):
        if sum(len(t.encode()) for t in templates.values()) > MOST_TEMPLATE_BYTES:
            raise ValueError(f"templates hold more than {MOST_TEMPLATE_BYTES} bytes")
        self.names = list(templates)
        self.words = [words_of(t.encode()).hashes for t in templates.values()]
        keys, owners, places = [], [], []
        for i, words in enumerate(self.words):
            runs = runs_of(words)
            at = np.arange(len(runs)) if len(runs) < 2 * WINNOW else winnow(runs)
            keys.append(runs[at])
            owners.append(np.full(len(at), i))
            places.append(at)
        keys, owners, places = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, owners, places))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners, self.places = keys[order], owners[order], places[order]

    def hits(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template, place in the document and place in the template of every run that is found."""
        low, high = np.searchsorted(self.keys, runs), np.searchsorted(self.keys, runs, "right")
        count = high - low
        at = np.flatnonzero(count)
        doc = np.repeat(at, count[at])
        entry = np.repeat(low[at] - np.cumsum(count[at]) + count[at], count[at]) + np.arange(len(doc))
        return self.owners[entry], doc, self.places[entry]


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Local alignment along the diagonals low - BAND .. high + BAND: template words matched, first and last word of the match.

    A match scores 2, a mismatch or a gap -1. Cell (i, d) is template word i against
    document word i + d; a word of the document alone moves to d + 1.
    """
    left, width, m = low - BAND, high - low + 2 * BAND + 1, len(template)
    diagonals = np.arange(width)
    score = np.zeros((m + 1, width + 1), np.int32)  # one diagonal more, always 0
    for i in range(m):
        at = i + left + diagonals
        inside = (at >= 0) & (at < len(words))
        equal = inside & (words[np.clip(at, 0, len(words) - 1)] == template[i])
        best = np.maximum(score[i, :-1] + np.where(equal, 2, -1), score[i, 1:] - 1)
        best = np.where(inside, np.maximum(best, 0), 0)
        score[i + 1, :-1] = np.maximum.accumulate(best + diagonals) - diagonals
    i, d = np.unravel_index(score.argmax(), score.shape)
    matched, first, last = 0, int(i + left + d - 1), int(i + left + d - 1)
    while i > 0 and score[i, d] > 0:
        at = i - 1 + left + d
        equal = 0 <= at < len(words) and words[at] == template[i - 1]
        if score[i, d] == score[i - 1, d] + (2 if equal else -1) and 0 <= at < len(words):
            matched, i = matched + equal, i - 1
            first = int(at) if equal else first
        elif d > 0 and score[i, d] == score[i, d - 1] - 1:
            d -= 1
        else:
            i, d = i - 1, d + 1
    return int(matched), first, last


def scan(text: bytes, index: Index, least: float = LEAST_COVERAGE) -> Iterator[tuple[str, int, float, int, int]]:
    """Template, words matched, coverage, and span in bytes of each place that covers enough of a template."""
    words = words_of(text)
    owner, doc, place = index.hits(runs_of(words.hashes))
    if not len(owner):
        return
    order = np.lexsort((doc, owner))
    now, end, tried = -1, -1, []
    for t, at, diagonal in zip(owner[order].tolist(), doc[order].tolist(), (doc - place)[order].tolist()):
        if t != now:
            now, end, tried = t, -1, []
        tried = [x for x in tried if x[1] > at]
        if at <= end or any(abs(diagonal - d) <= BAND // 2 for d, _ in tried):
            continue  # inside a match, or along a diagonal that led to none
        template = index.words[t]
        base = max(end + 1, diagonal - BAND, 0)
        window = words.hashes[base : diagonal + len(template) + BAND + 1]
        matched, first, last = align(template, window, diagonal - base, diagonal - base)
        if matched >= least * len(template):
            end = last + base
            yield index.names[t], matched, matched / len(template), int(words.starts[first + base]), int(words.ends[end])
        else:
            tried.append((diagonal, diagonal + len(template)))


def _scan(index: Index, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for name, matched, coverage, low, high in scan(text, index, least):
                    start = len(text[:low].decode())
                    rows.append((doc_id, name, matched, coverage, start, start + len(text[low:high].decode())))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=_NAMES)

    return run


_MATCHES = "doc_id long, license string, matched_words int, coverage double, span_start long, span_end long"
_NAMES = [x.split()[0] for x in _MATCHES.split(", ")]


def matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, license, matched_words, coverage, span_start, span_end: one row for each place of a template.

    The span is in code points of the text. Places of one template don't overlap; of
    overlapping ones the first is returned. Null, empty and clean texts have no row;
    repeated rows have theirs each, a null doc_id stays null; an empty table gives an
    empty result; other columns are ignored.
    """
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return read.mapInArrow(_scan(Index(templates), least), _MATCHES)
