"""Quality rules: zstandard compression bands over whole documents and fixed chunks, on top of counting rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Bytes -> (least, greatest) ratio of raw to compressed bytes for texts of that many bytes; between two lengths the
#: limits go linearly with the logarithm of the length, outside the table they stay. Longer texts compress better.
BANDS: dict[int, tuple[float, float]] = {
    32: (0.50, 1.50),
    128: (0.75, 1.65),
    256: (0.95, 1.85),
    512: (1.15, 2.05),
    1024: (1.35, 2.20),
    2048: (1.50, 2.32),
    4096: (1.60, 2.42),
    8192: (1.68, 2.52),
    16384: (1.74, 2.60),
    65536: (1.80, 2.80),
    1048576: (1.85, 3.20),
}
SYMBOLS = b"#*$%&|<>"
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def band(n_bytes: int, bands: dict[int, tuple[float, float]] = BANDS) -> tuple[float, float]:
    """Least and greatest ratio for a text of n_bytes."""
    at = np.log2(np.fromiter(bands, float))
    x = np.log2(max(n_bytes, 1))
    low, high = zip(*bands.values(), strict=True)
    return float(np.interp(x, at, low)), float(np.interp(x, at, high))


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a run of `window` words found twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += own[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    # Equal windows have equal hashes; the few with an equal hash are compared word by word.
    suspects = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    places: dict[tuple, int] = {}
    runs = [tuple(words[i : i + window]) for i in suspects.tolist()]
    for run in runs:
        places[run] = places.get(run, 0) + 1
    covered = np.zeros(len(words) + 1, np.int64)
    for i, run in zip(suspects.tolist(), runs, strict=True):
        if places[run] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


class Rules:
    """The counting rules and the compression bands for one text after another."""

    def __init__(self, level: int = 3, chunk: int = 4096, chunk_share: float = 0.25, min_words: int = 10, max_repeat_percent: int = 20, bands: dict[int, tuple[float, float]] = BANDS):
        self.zstd, self.chunk, self.chunk_share, self.bands = zstandard.ZstdCompressor(level=level), chunk, chunk_share, bands
        self.min_words, self.max_repeat_percent = min_words, max_repeat_percent
        self.chunk_band = band(chunk, bands)

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.zstd.compress(raw)) if raw else 1.0

    def __call__(self, text: str | None) -> tuple:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, n_chunks, n_bad_chunks, kept."""
        text = text or ""
        raw = text.encode("utf-8", "replace")
        words = raw.split()
        n = len(words)
        chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        repeats = repeated_words(words)
        failed = n < self.min_words or 100 * repeats > self.max_repeat_percent * n
        ratio = self.ratio(raw)
        chunks = [raw[i : i + self.chunk] for i in range(0, len(raw) - self.chunk + 1, self.chunk)]
        if chunks and len(raw) % self.chunk:
            chunks.append(raw[-self.chunk :])
        low, high = self.chunk_band
        bad = sum(not low <= self.ratio(x) <= high for x in chunks)
        low, high = band(len(raw), self.bands)
        fits = low <= ratio <= high and bad <= self.chunk_share * len(chunks)
        return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, ratio, len(chunks), bad, not failed and fits


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("zstd_ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()), ("kept", pa.bool_())]
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, zstd_ratio double, n_chunks long, n_bad_chunks long, kept boolean"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, the counts, base_failed, zstd_ratio, n_chunks, n_bad_chunks and kept, one row per row of docs.

    A text fails the base rules with under min_words words or with over max_repeat_percent of its words in 5-word
    windows found twice. Else it is kept if raw bytes per compressed byte lie within the band of its length and at most
    chunk_share of its chunks of `chunk` bytes lie outside the chunk's band: above a band text is repetitive, below it
    is incompressible. A text that doesn't end with a chunk has its last `chunk` bytes as one more, so its tail is judged
    like the rest; a text shorter than a chunk has none. Whole texts are read. A null text has no words and fails, as does
    the empty one; repeated rows are judged each; ids may be null; further columns are not carried. No rows, no rows.
    """

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(**settings)
        for batch in batches:
            found = [rules(x.as_py()) for x in batch.column(1)]
            columns = zip(*found, strict=True) if found else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True))], ["doc_id", *(k for k, _ in FIELDS)])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, {_DDL}")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules keeps; the texts are judged where they are read.

    Null and empty texts have no words and go. Repeated rows stay or go together, null ids don't matter, and columns may
    have any names, as none is added. No rows give no rows.
    """
    at = docs.columns.index(text_col)

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(**settings)
        for batch in batches:
            yield batch.filter(pa.array([rules(x.as_py())[-1] for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)
