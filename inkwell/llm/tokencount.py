"""Edit-aware token counting with a segment tree over the pre-tokens of a document.

Pre-tokens are matched from left to right and each is encoded alone, so a text's tokens are the sum over its
pre-tokens, and from any pre-token's start on they depend on what follows only. A leaf holds a run of pre-tokens as
(characters, tokens, pre-tokens); inner nodes hold sums. An edit walks down the tree to the leaf it touches, goes back by
`CONTEXT` pre-tokens, and matches again until a match starts where an untouched leaf starts; only those leaves and the
nodes above them change.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

#: Fixed value: the pattern that the byte-level BPE vocabularies split text with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens before the one an edit touches that are matched again. A pre-token's end depends on the character behind
#: it and, in white space, on what ends the run: the run's last character is a match of its own or starts the next.
CONTEXT = 3
_KEPT = 1 << 18


def content_mark(ranks: dict[bytes, int]) -> str:
    """A digest of a whole vocabulary, whatever the order of its entries."""
    return hashlib.sha256(b"".join(b"%d:%d:%b" % (r, len(x), x) for x, r in sorted(ranks.items()))).hexdigest()


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Counter:
    """Tokens of pre-tokens, each counted once while it is remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.split = regex.compile(pattern)
        self.encode = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def one(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= 48:
            if len(self.known) >= _KEPT:
                self.known.clear()
            self.known[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known.get
        return [known(p) or self.one(p) for p in pieces]


class TokenTree:
    """A text whose token count follows its edits."""

    def __init__(self, text: str, counter: Counter, leaf: int = 64):
        self.text, self.counter, self.leaf, self.encoded, self.rebuilt = text, counter, leaf, 0, 0
        self._build(counter.split.findall(text))

    def _build(self, pieces: list[str]) -> None:
        runs = [pieces[i : i + self.leaf] for i in range(0, len(pieces), self.leaf)]
        counts = self.counter.counts(pieces)
        self.slots = max(1, len(runs))
        self.size = 1 << (self.slots - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 3), np.int64)
        for k, run in enumerate(runs):
            self.sums[self.size + k] = sum(map(len, run)), sum(counts[k * self.leaf : (k + 1) * self.leaf]), len(run)
        for level in range(self.size.bit_length() - 2, -1, -1):
            a, b = 1 << level, 2 << level
            self.sums[a:b] = self.sums[2 * a : 2 * b : 2] + self.sums[2 * a + 1 : 2 * b : 2]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def _find(self, char: int) -> tuple[int, int]:
        """(leaf, its start) of the leaf that holds the character; past the end the last slot."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            here = int(self.sums[node, 0])
            if char >= start + here and node + 1 < 2 * self.size and self.sums[node + 1, 0]:
                start += here
                node += 1
        return node - self.size, start

    def _update(self, first: int, last: int) -> None:
        a, b = (first + self.size) // 2, (last + self.size) // 2
        while a:
            for node in range(a, b + 1):
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            a, b = a // 2, b // 2

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace the characters from start to end by new; the tokens of the whole text afterwards."""
        start, end = min(start, len(self.text)), min(max(start, end), len(self.text))
        first, at = self._find(max(0, start - 1))
        piece_ends = 0
        while first and piece_ends < CONTEXT:  # whole leaves, so at least CONTEXT pre-tokens
            first -= 1
            at -= int(self.sums[self.size + first, 0])
            piece_ends += int(self.sums[self.size + first, 2])
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        last, stop = first, at
        pieces: list[str] = []
        # Leaf ends behind the edit, in the new text's characters, where the old matches may go on.
        while last < self.slots and (stop < end or (stop == end and not pieces)):
            stop += int(self.sums[self.size + last, 0])
            last += 1
        goal, here = stop + shift, at
        for m in self.counter.split.finditer(self.text, at):
            while here > goal and last < self.slots:
                goal += int(self.sums[self.size + last, 0])
                last += 1
            if here == goal and here >= start + len(new) and last <= self.slots and pieces:
                break
            pieces.append(m[0])
            here = m.end()
        while here > goal and last < self.slots:
            goal += int(self.sums[self.size + last, 0])
            last += 1
        if here >= len(self.text):
            last = self.slots
        self.encoded += sum(map(len, pieces))
        slots = last - first
        if slots < 1 or len(pieces) > 4 * self.leaf * slots:
            self.rebuilt += 1
            self._build(self.counter.split.findall(self.text))
            return self.tokens
        counts = self.counter.counts(pieces)
        per = -(-len(pieces) // slots)
        for k in range(slots):
            run, own = pieces[k * per : (k + 1) * per], counts[k * per : (k + 1) * per]
            self.sums[self.size + first + k] = sum(map(len, run)), sum(own), len(run)
        self._update(first, last - 1)
        return self.tokens


_BUILT: dict[str, Counter] = {}


def _built(ranks: dict[bytes, int], mark: str) -> Counter:
    if mark not in _BUILT:
        _BUILT.clear()
        _BUILT[mark] = Counter(ranks)
    return _BUILT[mark]


def count_edited(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", leaf: int = 64) -> DataFrame:
    """doc_id, n_tokens (before), n_tokens_after, n_chars_after, n_chars_encoded, edits_done for every row of docs.

    docs has a column of edits, an array of (at, drop, add): from character `at` of the text as the edits before left
    it, `drop` characters go and the string `add` comes. Places behind the end mean the end, negative ones the start;
    null parts of an edit count as 0 and the empty string, a null edit or list is none. n_chars_encoded: characters
    matched again for the edits. A null text is the empty text. Rows are counted each, ids may be null or repeated,
    other columns are not carried. The vocabulary file is read on the driver. No rows give no rows.
    """
    ranks = read_ranks(vocabulary)
    mark = content_mark(ranks)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[edits_col].alias("edits"))
    names = ["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_chars_encoded", "edits_done"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _built(ranks, mark)
        for batch in batches:
            out: list[list[int]] = [[] for _ in names[1:]]
            for text, edits in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                tree = TokenTree(text.as_py() or "", counter, leaf)
                before, done = tree.tokens, 0
                for e in edits or []:
                    if e:
                        at = max(0, e["at"] or 0)
                        tree.edit(at, at + max(0, e["drop"] or 0), e["add"] or "")
                        done += 1
                for column, x in zip(out, (before, tree.tokens, len(tree.text), tree.encoded, done), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} long" for n in names[1:])]))
