"""Plain versions of the operators, one document or pair at a time."""

import collections
import math
import re
import zlib

import xxhash
import zstandard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def simhash(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, linked):
    """Least member of each key's class, by trying every pair."""
    up = {k: k for k in keys}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(keys)
    for i, a in enumerate(order):
        for b in order[:i]:
            if linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def near_copies(docs):
    """{id: class} of (id, text) by fingerprints."""
    prints = {i: simhash(t) for i, t in docs}
    return classes(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def shingle_set(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_texts(docs):
    """{id: class} of (id, text) by fingerprints or by a similarity of 0.8 of the sets of five-word shingles."""
    prints, sets = {i: simhash(t) for i, t in docs}, {i: shingle_set(t) for i, t in docs}

    def linked(a, b):
        return (prints[a] ^ prints[b]).bit_count() <= 3 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0

    return classes(list(prints), linked)


def quality(text, bands):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    text = text or ""
    w = words(text)
    runs = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    raw = text.encode()
    press = zstandard.ZstdCompressor(level=3)

    def fits(part, size):
        xs = sorted(bands)
        at = math.log2(max(size, 1))
        limits = []
        for side in (0, 1):
            if at <= math.log2(xs[0]):
                limits.append(bands[xs[0]][side])
            elif at >= math.log2(xs[-1]):
                limits.append(bands[xs[-1]][side])
            else:
                k = next(k for k in range(len(xs) - 1) if at <= math.log2(xs[k + 1]))
                a, b = math.log2(xs[k]), math.log2(xs[k + 1])
                limits.append(bands[xs[k]][side] + (at - a) / (b - a) * (bands[xs[k + 1]][side] - bands[xs[k]][side]))
        ratio = len(part) / len(press.compress(part)) if part else 1.0
        return limits[0] <= ratio <= limits[1]

    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096) if len(raw) - i >= 4096]
    chunks += [raw[-4096:]] if len(raw) > 4096 and len(raw) % 4096 else []
    verdict = fits(raw, len(raw)) and sum(not fits(c, 4096) for c in chunks) <= 0.25 * len(chunks)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed, not failed and verdict


def dedup_lines(docs, least=50):
    """{id: text} of (id, text): every run of `least` words or more is looked up among all runs that start before it."""
    lines = {i: [(k, x.strip(" \t\r\x0b\x0c"), len(words(x))) for k, x in enumerate(t.split("\n")) if words(x)] for i, t in docs if t is not None}
    seen, kept = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        if t is None:
            kept[i] = None
            continue
        gone, own = set(), lines[i]
        for a in range(len(own)):
            runs = []
            for b in range(a, len(own)):
                if sum(x[2] for x in own[a : b + 1]) >= least:
                    run = tuple(x[1] for x in own[a : b + 1])
                    if run in seen:
                        gone |= set(range(own[a][0], own[b][0] + 1))
                    runs.append(run)
                    if sum(x[2] for x in own[a + 1 : b + 1]) >= least:
                        break  # what is longer holds a shorter run from the next line on
            seen.update(runs)
        kept[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return kept


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def crc(text):
    return zlib.crc32((text or "").encode())


def targets(sizes):
    """{source: target} by filling until nothing is above its ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= more


def highest_quotients(votes, house):
    seats = dict.fromkeys(votes, 0)
    for _ in range(house):
        won = min(votes, key=lambda s: (-votes[s] / (2 * seats[s] + 1), s))
        seats[won] += 1
    return seats
