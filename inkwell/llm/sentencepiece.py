"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

A model file gives the pieces and their scores; the driver builds the trie once and ships its arrays with the tasks.
White space is marked by U+2581; a text gets one marker in front. Where no piece holds a marker behind another
character, the best segmentation of a text is that of its words, so words are segmented one by one and remembered; else
whole texts are. A character that no piece covers costs 10 less than the least score and becomes its UTF-8 bytes, or
the unknown piece in a model without bytes. Decoding joins the pieces' bytes, so a character split into bytes comes back.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words a worker remembers, characters of texts it takes together, words it segments together.
_KEPT, _CHARS, _ROWS = 1 << 18, 1 << 21, 1 << 13


def _fields(raw: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            size = number()
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", raw[at : at + size])[0]
            at += size


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, log score, type) of a model file, by id.

    A Unigram model's scores are logarithms and stay. Those of other kinds of model are negated ranks of merges: by
    Zipf's law a piece of rank r then gets the log score -ln(r) - ln(sum of 1 / r). Models whose normaliser changes more
    than a leading space are an error, as their texts would be encoded wrongly.
    """
    with open(path, "rb") as f:
        found = list(_fields(f.read()))
    # Fields of the normaliser's message and what they are where they are left out.
    law = {1: b"", 2: b"", 3: 1, 4: 1, 5: 1} | next((dict(_fields(v)) for k, v in found if k == 3), {})
    if law[2] or law[4] or not law[3] or not law[5] or law[1] not in (b"", b"identity"):
        raise ValueError("only models with the identity normaliser, a leading space, kept spaces and escaped spaces are supported")
    messages = [dict(_fields(v)) for k, v in found if k == 1]
    pieces = [(m[1].decode(), float(m.get(2, 0.0)), int(m.get(3, NORMAL))) for m in messages]
    if next((dict(_fields(v)).get(3, 1) for k, v in found if k == 2), 1) == 1:
        # A piece that its user defines wins over all others of its length together.
        best = max((s for _, s, kind in pieces if kind == NORMAL), default=0.0)
        return [(p, len(p.encode()) * best - 0.1 if kind == USER else s, kind) for p, s, kind in pieces]
    ranks = [max(1.0, -s + 1.0) for _, s, kind in pieces if kind in (NORMAL, USER)]
    total = math.log(sum(1 / r for r in ranks)) if ranks else 0.0
    return [(p, -math.log(max(1.0, -s + 1.0)) - total if kind in (NORMAL, USER) else s, kind) for p, s, kind in pieces]


def double_array(keys: list[bytes]) -> tuple[array, array, array]:
    """base, check and value of a double-array trie; keys must be sorted and distinct, value is the key's index or -1.

    From state s the byte c leads to t = base[s] + c + 1 if check[t] == s.
    """
    base, check, value = array("i", [0]), array("i", [-2]), array("i", [-1])

    def grow(n: int) -> None:
        more = n - len(base)
        if more > 0:
            base.extend([0] * more)
            check.extend([-1] * more)
            value.extend([-1] * more)

    free = 1
    work = [(0, 0, len(keys), 0)]
    while work:
        state, a, b, depth = work.pop()
        if a < b and len(keys[a]) == depth:
            value[state] = a
            a += 1
        starts: list[tuple[int, int]] = []
        for i in range(a, b):
            if not starts or keys[i][depth] != starts[-1][0]:
                starts.append((keys[i][depth], i))
        if not starts:
            continue
        while free < len(check) and check[free] != -1:
            free += 1
        at, tried = max(0, free - starts[0][0] - 1), 0
        while True:
            grow(at + 258)
            if all(check[at + c + 1] == -1 for c, _ in starts):
                break
            at, tried = at + 1, tried + 1
        if tried > 32:  # holes before this one are left, or the search would pass them again and again
            free = max(free, at + starts[0][0] + 1)
        base[state] = at
        for k, (c, i) in enumerate(starts):
            check[at + c + 1] = state
            work.append((at + c + 1, i, starts[k + 1][1] if k + 1 < len(starts) else b, depth + 1))
    return base, check, value


@dataclass
class Model:
    """Pieces with scores, ready to encode and decode."""

    pieces: list[tuple[str, float, int]]
    base: array = field(init=False)
    check: array = field(init=False)
    value: array = field(init=False)

    def __post_init__(self) -> None:
        found: dict[bytes, int] = {}
        for i, (piece, _, kind) in enumerate(self.pieces):
            if kind in (NORMAL, USER) and piece:
                found.setdefault(piece.encode(), i)
        keys = sorted(found)
        self.base, self.check, value = double_array(keys)
        ids = [found[k] for k in keys]
        self.value = array("i", [ids[v] if v >= 0 else -1 for v in value])
        self.scores = [s for _, s, _ in self.pieces]
        pad = array("i", [-1] * 258)
        self.arrays = *(np.array(x + pad, np.int32) for x in (self.base, self.check, self.value)), np.array([*self.scores, 0.0])
        spoken = [(p, s) for p, s, kind in self.pieces if kind in (NORMAL, USER)]
        self.missing = min((s for _, s in spoken), default=0.0) - 10.0
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        by_word = not any(MARK in p.lstrip(MARK) for p, _ in spoken)
        alone = not any("\n" in p and p != "\n" for p, _ in spoken)
        self.split = re.compile((r" +[^ \n]*|[^ \n]+|\n" if alone else r" +[^ ]*|[^ ]+") if by_word else r"(?s).+").findall
        self._forget()

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text that has markers for spaces; of equal ones that with the earlier split."""
        raw = text.encode("utf-8", "replace")
        n = len(raw)
        base, check, value, scores, end = self.base, self.check, self.value, self.scores, len(self.check)
        reach: list[float | None] = [None] * (n + 1)
        reach[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at = 0
        while at < n:
            lead = raw[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, covered = reach[at], 0, False
            for k in range(at, n):
                to = base[state] + raw[k] + 1
                if to >= end or check[to] != state:
                    break
                state = to
                if value[to] >= 0:
                    score = here + scores[value[to]]
                    if reach[k + 1] is None or score > reach[k + 1]:
                        reach[k + 1], back[k + 1] = score, (at, value[to])
                    covered = covered or k + 1 == at + width
            if not covered:
                score, to = here + self.missing, at + width
                if reach[to] is None or score > reach[to]:
                    reach[to], back[to] = score, (at, -1)
            at += width
        found: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                found.append(piece)
            elif self.bytes:
                found.extend(self.bytes[b] for b in reversed(raw[start:at]))
            elif not found or found[-1] != self.unknown:  # a run of unknown characters is one piece
                found.append(self.unknown)
            at = start
        return found[::-1]

    def best_of_many(self, words: list[str]) -> list[list[int] | None]:
        """best() of many words at once: the same search with all words' states in arrays. None: needs best()."""
        raws = [w.replace(" ", MARK).encode("utf-8", "replace") for w in words]
        found: list[list[int] | None] = [None] * len(words)
        order = np.argsort(np.fromiter(map(len, raws), np.int64, len(raws)), kind="stable").tolist()
        for a in range(0, len(order), _ROWS):
            rows = order[a : a + _ROWS]
            for i, ids in zip(rows, self._search([raws[i] for i in rows]), strict=True):
                found[i] = ids
        return found

    def _search(self, raws: list[bytes]) -> list[list[int] | None]:
        """best() of texts in the order of their lengths; arrays go by place first, then by text."""
        base, check, value, scores = self.arrays
        longest, n = len(raws[-1]), len(raws)
        size = np.fromiter(map(len, raws), np.int32, n)
        text = np.frombuffer(b"".join(r.ljust(longest, b"\0") for r in raws), np.uint8).reshape(n, longest).T.astype(np.int32)
        reach = [np.full(n, -np.inf) for _ in range(longest + 4)]
        reach[0][:] = 0.0
        start_of, piece_of = np.zeros((longest + 4, n), np.int32), np.full((longest + 4, n), -1, np.int32)
        for at in range(longest):
            lead = text[at]
            here = np.flatnonzero((size > at) & (lead & 0xC0 != 0x80))
            if not len(here):
                continue
            lead = lead[here]
            width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            bare, so_far = np.ones(len(here), bool), reach[at][here]
            live, state = np.arange(len(here)), np.zeros(len(here), np.int32)
            for k in range(at, longest):
                to = base[state] + text[k][here[live]] + 1
                goes = np.flatnonzero(check[to] == state)  # no piece has the byte 0 that fills up short texts
                live, state = live[goes], to[goes]
                if not len(live):
                    break
                piece = value[state]
                ends = np.flatnonzero(piece >= 0)
                if not len(ends):
                    continue
                on, piece = live[ends], piece[ends]
                bare[on[width[on] == k + 1 - at]] = False
                who, score = here[on], so_far[on] + scores[piece]
                better = np.flatnonzero(score > reach[k + 1][who])
                who = who[better]
                reach[k + 1][who], start_of[k + 1][who], piece_of[k + 1][who] = score[better], at, piece[better]
            for w in (1, 2, 3, 4):
                on = np.flatnonzero(bare & (width == w))
                score, who = so_far[on] + self.missing, here[on]
                better = score > reach[at + w][who]
                who = who[better]
                reach[at + w][who], start_of[at + w][who], piece_of[at + w][who] = score[better], at, -1
        steps, at, every, whole = [], size.copy(), np.arange(n), np.ones(n, bool)
        while at.any():
            piece = piece_of[at, every]
            whole &= (at == 0) | (piece >= 0)
            steps.append(np.where(at > 0, piece, -1))
            at = np.where(at > 0, start_of[at, every], 0)
        if not steps:
            return [[] for _ in raws]
        counts = np.sum([x >= 0 for x in steps], axis=0).tolist()
        ids = np.stack(steps[::-1], axis=1).tolist()
        return [x[len(x) - c :] if ok else None for x, c, ok in zip(ids, counts, whole.tolist(), strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Give words a place in the store of remembered ids."""
        known = self.best_of_many([w for w in words if len(w) <= 48])
        short = iter(known)
        for w in words:
            ids = next(short) if len(w) <= 48 else None
            if ids is None:
                ids = self.best(w.replace(" ", MARK))
            self.place[w] = len(self.ends)
            self.stored.extend(ids)
            self.ends.append(len(self.stored))

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and end); the words new among them are segmented together."""
        flat, counts = [np.zeros(0, np.int32)], []
        a = 0
        while a < len(texts):
            b, chars = a, 0
            while b < len(texts) and chars < _CHARS:
                chars += len(texts[b])
                b += 1
            words = [self.split(" " + t.replace(MARK, " ")) if t else [] for t in texts[a:b]]
            joined = list(chain.from_iterable(words))
            at = np.fromiter(map(self.place.get, joined, repeat(-1)), np.int64, len(joined))
            missing = np.flatnonzero(at < 0)
            if len(missing):
                new = list(dict.fromkeys(joined[i] for i in missing.tolist()))
                if len(self.place) + len(new) > _KEPT or len(self.stored) > 8 * _KEPT:
                    self._forget()
                    new, missing = list(dict.fromkeys(joined)), np.arange(len(joined))
                self._learn(new)
                at[missing] = np.fromiter((self.place[joined[i]] for i in missing.tolist()), np.int64, len(missing))
                long = [w for w in new if len(w) > 48]
            ends, stored = np.frombuffer(self.ends, np.int64), np.frombuffer(self.stored, np.int32)
            first = ends[at - 1] * (at > 0)
            size = ends[at] - first
            upto = np.cumsum(size)
            total = int(upto[-1]) if len(upto) else 0
            flat.append(stored[np.repeat(first - (upto - size), size) + np.arange(total)] if total else np.zeros(0, np.int32))
            by_text = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            counts.append(np.diff(np.concatenate([[0], upto])[by_text]))
            if len(missing):
                for w in long:  # words too long to be remembered
                    del self.place[w]
            del ends, stored  # the arrays can grow again
            a = b
        return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype(np.int64)

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ends, self.stored = array("q"), array("i")

    def encode(self, text: str) -> array:
        """Ids of a text."""
        return array("i", self.encode_many([text])[0].tolist())

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


#: Rows that are turned into ids together.
_SLICE = 1000
#: The models that this Python worker has built, with the words each remembers; a worker runs many tasks.
_BUILT: dict[int, Model] = {}


def _built(pieces: list[tuple[str, float, int]]) -> Model:
    key = zlib.crc32(repr(pieces).encode("utf-8", "replace"))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Model(pieces)
    return _BUILT[key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, token_ids, n_tokens, n_byte_tokens, round_trip for every row of docs.

    round_trip: decoding the ids gives the text again. The model file is read on the driver. A null text has null ids,
    0 tokens and null round_trip; the empty text has no ids. U+2581 in a text reads as a space, so such a text does not
    come back. Ids and kept columns may be null or repeated; other columns are not carried. No rows give no rows.
    """
    pieces = read_pieces(model_path)
    rows = docs.select(docs[id_col].alias("doc_id"), *(docs[c] for c in keep), docs[text_col])
    names = ["doc_id", *keep, "token_ids", "n_tokens", "n_byte_tokens", "round_trip"]
    kinds = [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, rows.schema.fields[:-1], strict=False)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _built(pieces)
        is_byte = np.zeros(len(pieces), bool)
        is_byte[list(model.bytes.values())] = True
        for batch in (b.slice(i, _SLICE) for b in batches for i in range(0, b.num_rows, _SLICE)):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            flat, ends = model.encode_many([t or "" for t in texts])
            in_bytes = np.diff(np.concatenate([[0], np.cumsum(is_byte[flat])])[ends])
            spans = ends.tolist()
            back = [None if t is None else model.decode(flat[a:b].tolist()) == t for t, (a, b) in zip(texts, pairwise(spans), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([t is None for t in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(np.diff(ends)), pa.array(in_bytes), pa.array(back, pa.bool_())], names)

    return rows.mapInArrow(run, ", ".join([*kinds, "token_ids array<int>", "n_tokens long", "n_byte_tokens long", "round_trip boolean"]))
