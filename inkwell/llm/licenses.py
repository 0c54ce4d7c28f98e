"""License scans: winnowed template fingerprints in an inverted index, then banded alignment of the candidates.

Templates and texts are sequences of lower-cased words. Hashes of `gram` words are winnowed: of each `window`
neighbouring ones the least is a fingerprint, so a run of gram + window - 1 words that a text shares with a template
gives a common one. Templates of up to `short` words have all their pairs of words as fingerprints: a find of theirs always
shares one. The index maps a fingerprint to (template, place); each hit names a diagonal, place in the text less place in
the template. Where the words around a hit suffice for a find, the template is aligned with the text within the band
around the diagonals: matches, at least cost of skips on either side. One pass gives the best alignment for every end, so
all copies of a template are found at once; what they leave of the text is aligned again until nothing is found.

Coverage is the share of the template's words that match. A find has at least min_coverage of them, and its words in the
text are at least that share matches. The templates are few and fixed, and their index goes to the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm.license_texts import TEMPLATES

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.uint64).max
#: An alignment's state in 63 bits: score, matches, and how far its first word lies before the end of the piece.
_SCORE, _MATCH, _FIRST = np.int64(1 << 46), np.int64(1 << 30), (1 << 30) - 1
_PIECE = 1 << 16


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Index:
    """Templates with their inverted index of winnowed fingerprints."""

    def __init__(self, templates: dict[str, list[str]], gram: int = 3, window: int = 2, short: int = 12, band: int = 2, band_share: float = 0.25):
        self.band, self.band_share = band, band_share
        self.names = [(name, i) for name, texts in templates.items() for i in range(len(texts))]
        self.words = [words_of(templates[name][i]) for name, i in self.names]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for x in self.words for w in x}))}
        self.ids = [np.array([self.vocabulary[w] for w in x], np.uint64) for x in self.words]
        #: (gram, window, its sorted fingerprints, their templates, their places) for short templates and for the others.
        self.indexes = []
        for g, w, members in ((2, 1, [t for t, x in enumerate(self.ids) if len(x) <= short]), (gram, window, [t for t, x in enumerate(self.ids) if len(x) > short])):
            parts = [(*self.fingerprints(self.ids[t], g, w), t) for t in members]
            marks = np.concatenate([np.zeros(0, np.uint64), *(x for x, _, _ in parts)])
            where = np.concatenate([np.zeros(0, np.int64), *(x for _, x, _ in parts)])
            owner = np.repeat(np.array([t for _, _, t in parts], np.int64), [len(x) for x, _, _ in parts])
            order = np.argsort(marks, kind="stable")
            self.indexes.append((g, w, marks[order], owner[order], where[order]))
        self.has = [np.isin(np.arange(len(self.vocabulary) + 1), x) for x in self.ids]

    @staticmethod
    def fingerprints(ids: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, places) of the least hash of every window, the left one of equals; grams with an unknown word (0) are none."""
        n = len(ids) - gram + 1
        if n < 1:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        mixed, whole = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(gram):
            mixed = (mixed ^ ids[k : k + n]) * _MIX
            mixed ^= mixed >> np.uint64(29)
            whole &= ids[k : k + n] > 0
        mixed[~whole] = _NONE
        if window > 1:
            views = np.lib.stride_tricks.sliding_window_view(mixed, min(window, n))
            least = np.zeros(n, bool)
            least[views.argmin(1) + np.arange(len(views))] = True
            chosen = np.flatnonzero(least & whole)
        else:
            chosen = np.flatnonzero(whole)
        return mixed[chosen], chosen

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(templates, places in the text, diagonals) of all common fingerprints, by template and diagonal."""
        found = []
        for gram, window, marks, owner, where in self.indexes:
            own, places = self.fingerprints(ids, gram, window)
            low = np.searchsorted(marks, own, "left")
            counts = np.searchsorted(marks, own, "right") - low
            at = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            there = np.repeat(places, counts)
            found.append((owner[at], there, there - where[at]))
        t, place, diagonal = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((diagonal, t))
        return t[order], place[order], diagonal[order]

    def width(self, t: int) -> int:
        return max(self.band, math.ceil(self.band_share * len(self.ids[t])))

    def pieces(self, ids: np.ndarray, t: int, place: np.ndarray, diagonal: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int]]:
        """(begin, end, least diagonal, greatest diagonal) of the parts of a text that may hold a find of template t.

        They lie within the band of a hit, and some window as long as a find may be has enough of the template's words.
        """
        size, width, n = len(self.ids[t]), self.width(t), len(ids)
        need, span = math.ceil(least * size - 1e-9), int(size / least + 1e-9)
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, np.clip(diagonal - width, 0, n), 1)
        np.add.at(near, np.clip(diagonal + size + width, 0, n), -1)
        inside = np.cumsum(near[:n]) > 0
        known = np.concatenate([[0], np.cumsum(self.has[t][ids.astype(np.int64)] & inside)])
        begins = np.flatnonzero(known[np.minimum(np.arange(n) + span, n)] - known[:n] >= need)
        if not len(begins):
            return
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, begins, 1)
        np.add.at(cover, np.minimum(begins + span, n), -1)
        edges = np.diff(np.concatenate([[0], ((np.cumsum(cover[:n]) > 0) & inside).astype(np.int8), [0]]))
        order = np.argsort(place, kind="stable")
        place, diagonal = place[order], diagonal[order]
        for a, b in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True):
            i, j = np.searchsorted(place, [a, b])
            if j > i:
                yield a, b, int(diagonal[i:j].min()), int(diagonal[i:j].max())

    def ends(self, ids: np.ndarray, t: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, words matched, first place) of the best alignment of template t that ends with a match at each place.

        A match counts 2, a skipped word on either side costs 1; words before and behind the alignment cost nothing. Of
        equal scores more matches win, then the earlier first place. low and high bound the diagonals, less the band.
        """
        n, size = len(ids), len(self.ids[t])
        if n > _PIECE:  # an alignment reaches less than three template lengths back
            out: list[tuple[np.ndarray, ...]] = []
            for a in range(0, n, _PIECE):
                back = max(0, a - 3 * size)
                score, matched, first = self._ends(ids[back : a + _PIECE], t, low - back, high - back)
                out.append((score[a - back :], matched[a - back :], first[a - back :] + back))
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))
        return self._ends(ids, t, low, high)

    def _ends(self, ids: np.ndarray, t: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, width = len(ids), self.width(t)
        low, high = low - width, high + width
        row, best = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)  # row[j + 1]: the best state at place j
        fresh, ramp = 2 * _SCORE + _MATCH + _FIRST - np.arange(n), np.arange(n) * _SCORE
        for i, word in enumerate(self.ids[t]):
            a, b = max(0, i + low), min(n, i + high + 1)
            if a >= b:
                continue
            before, above = row[a:b], row[a + 1 : b + 1]
            new = np.where(above >= 2 * _SCORE, above - _SCORE, 0)
            same = np.flatnonzero(ids[a:b] == word)
            if len(same):
                known = before[same]
                state = np.where(known > 0, known + (2 * _SCORE + _MATCH), fresh[a:b][same])
                best[a + same] = np.maximum(best[a + same], state)
                new[same] = np.maximum(new[same], state)
            new += ramp[a:b]
            np.maximum.accumulate(new, out=new)
            new -= ramp[a:b]
            new[new < _SCORE] = 0
            row[a + 1 : b + 1] = new
        return best // _SCORE, best % _SCORE // _MATCH, np.where(best > 0, _FIRST - best % _MATCH, -1)

    def finds(self, ids: np.ndarray, t: int, low: int, high: int, least: float) -> list[tuple[int, int, int]]:
        """(words matched, first, last place) of all finds of template t in a piece, none over another.

        Better scores first, then more matches, then the earlier place. What lies between is aligned again.
        """
        found, parts, size = [], [(0, len(ids))], len(self.ids[t])
        while parts:
            a, b = parts.pop()
            if b - a < least * size - 1e-9:
                continue
            score, matched, first = self.ends(ids[a:b], t, low - a, high - a)
            last = np.arange(b - a)
            fit = np.flatnonzero((matched >= least * size - 1e-9) & (matched >= least * (last - first + 1) - 1e-9))
            order = fit[np.lexsort((first[fit], -matched[fit], -score[fit]))]
            taken = np.zeros(b - a, bool)
            for j in order.tolist():
                f = int(first[j])
                if not taken[f : j + 1].any():
                    taken[f : j + 1] = True
                    found.append((int(matched[j]), a + f, a + j))
            if taken.any():
                edges = np.diff(np.concatenate([[0], (~taken).astype(np.int8), [0]]))
                parts += [(a + x, a + y) for x, y in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True)]
        return found


def scan(text: str | None, index: Index, min_coverage: float = 0.8) -> list[tuple[str, int, float, int, int, int]]:
    """(licence, template, coverage, words matched, start, end) for every template found, by place; spans in characters.

    Of overlapping finds the one with more words stays, then the one with higher coverage, then the first in name.
    """
    words = words_of(text or "")
    ids = np.fromiter(map(index.vocabulary.get, words, repeat(0)), np.uint64, len(words))
    if not ((ids[1:] > 0) & (ids[:-1] > 0)).any():  # every fingerprint is of two known words or more
        return []
    owners, places, diagonals = index.hits(ids)
    if not len(owners):
        return []
    found = []
    edges = np.flatnonzero(np.diff(owners)) + 1
    for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(owners)], strict=True):
        t = int(owners[i])
        for a, b, low, high in index.pieces(ids, t, places[i:j], diagonals[i:j], min_coverage):
            found += [(matched, matched / len(index.ids[t]), t, a + first, a + last) for matched, first, last in index.finds(ids[a:b], t, low - a, high - a, min_coverage)]
    if not found:
        return []
    spans = [m.span() for m in _WORD.finditer(text)] if len(text) == len(text.lower()) else _spans(text)
    taken, kept = np.zeros(len(ids), bool), []
    for x in sorted(found, key=lambda x: (-x[0], -x[1], index.names[x[2]], x[3], x[4])):
        if not taken[x[3] : x[4] + 1].any():
            taken[x[3] : x[4] + 1] = True
            kept.append(x)
    kept.sort(key=lambda x: x[3])
    return [(*index.names[t], coverage, matched, spans[first][0], spans[last][1]) for matched, coverage, t, first, last in kept]


def _spans(text: str) -> list[tuple[int, int]]:
    """Places of the words of text.lower() in text, where lower-casing changes the length."""
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in _WORD.finditer(text.lower())]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = 0.8, **settings) -> DataFrame:
    """One row per licence text found: doc_id, license, template, coverage, words_matched, start, end, in whole texts.

    start and end are code points of the text. Documents without one give no row, as do null and empty texts. Repeated
    rows are scanned each; ids may be null; further columns are not carried.
    """
    names = ["doc_id", "license", "template", "coverage", "words_matched", "start", "end"]
    types = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, **settings)
        for batch in batches:
            rows, found = [], []
            for k, x in enumerate(batch.column(1)):
                for one in scan(x.as_py(), index, min_coverage):
                    rows.append(k)
                    found.append(one)
            columns = zip(*found, strict=True) if found else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, license string, template long, coverage double, words_matched long, start long, `end` long")
