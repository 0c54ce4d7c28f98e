import random

import pytest

from inkwell.llm import licenses
from inkwell.llm.license_texts import TEMPLATES

INDEX = licenses.Index(TEMPLATES)


@pytest.mark.parametrize("template", [x for texts in TEMPLATES.values() for x in texts])
@pytest.mark.parametrize("between", [" ", "\n", " and also\n", " one two three four "])
def test_copies_in_a_row_are_found_each(template, between):
    text = between.join([template] * 7)
    got = licenses.scan(text, INDEX)
    step = len(template) + len(between)
    places = [m.span() for m in licenses._WORD.finditer(template)]
    assert [(x[4], x[5]) for x in got] == [(k * step + places[0][0], k * step + places[-1][1]) for k in range(7)]


def test_hundreds_of_lines_with_changes():
    lines = ["Released under the MIT License.", "Released under MIT License.", "Licensed under CC BY 4.0."] * 100
    text = "\n".join(lines)
    assert [text[x[4] : x[5]] + "." for x in licenses.scan(text, INDEX)] == lines


def full_ends(text, template):
    """{last place: (score, matches, -first)} of the best alignment that ends there, over all places and no band."""
    row, best = {}, {}
    for word in template:
        new = {}
        for j, other in enumerate(text):
            options = []
            if word == other:
                s, m, f = row.get(j - 1, (0, 0, -j))
                options.append((s + 2, m + 1, f))
                best[j] = max(best.get(j, (0, 0, 0)), options[0])
            options += [(s - 1, m, f) for s, m, f in (row.get(j, (0, 0, 0)), new.get(j - 1, (0, 0, 0))) if s > 1]
            if options:
                new[j] = max(options)
        row = new
    return best


def full_finds(text, template, least=0.8):
    found, parts = [], [(0, len(text))]
    while parts:
        a, b = parts.pop()
        ends = full_ends(text[a:b], template)
        fit = [(-s, -m, -f, j) for j, (s, m, f) in ends.items() if m >= least * len(template) and m >= least * (j + f + 1)]
        free = set(range(b - a))
        for _, m, f, j in sorted(fit):
            if free.issuperset(range(f, j + 1)):
                free -= set(range(f, j + 1))
                found.append((-m, a + f, a + j))
        if len(free) < b - a:
            runs = [k for k in sorted(free) if k - 1 not in free]
            for x in runs:
                y = x
                while y in free:
                    y += 1
                parts.append((a + x, a + y))
    return found


def test_finds_by_a_full_alignment_at_every_place():
    rng = random.Random(8)
    some = [t for t in range(len(INDEX.names)) if len(INDEX.ids[t]) <= 45]
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice(some)
            part = list(INDEX.words[t])
            for _ in range(rng.randrange(0, 1 + len(part) // 6)):
                at = rng.randrange(len(part))
                change = rng.choice(["swap", "drop", "add"])
                part[at : at + (change != "add")] = [] if change == "drop" else [rng.choice(["zzz", "license", "the"])]
            words += part + ["other"] * rng.choice([0, 0, 1, 3])
        want = []
        for t in range(len(INDEX.names)):
            want += [(m, m / len(INDEX.words[t]), t, a, b) for m, a, b in full_finds(words, INDEX.words[t])]
        kept, free = [], set(range(len(words)))
        for x in sorted(want, key=lambda x: (-x[0], -x[1], INDEX.names[x[2]], x[3], x[4])):
            if free.issuperset(range(x[3], x[4] + 1)):
                free -= set(range(x[3], x[4] + 1))
                kept.append((*INDEX.names[x[2]], x[0], x[3], x[4]))
        text = " ".join(words)
        places = {m.start(): k for k, m in enumerate(licenses._WORD.finditer(text))}
        ends = {m.end(): k for k, m in enumerate(licenses._WORD.finditer(text))}
        got = [(name, i, m, places[a], ends[b]) for name, i, _, m, a, b in licenses.scan(text, INDEX)]
        assert got == sorted(kept, key=lambda x: x[3])


def test_long_texts_are_cut_into_pieces_without_loss(monkeypatch):
    text = " and then ".join(TEMPLATES["MIT"] * 12 + TEMPLATES["Apache-2.0"] * 9)
    want = licenses.scan(text, INDEX)
    monkeypatch.setattr(licenses, "_PIECE", 97)
    assert licenses.scan(text, INDEX) == want and len(want) == 12 * 3 + 9 * 2


@pytest.mark.parametrize("part", ["Released under the MIT License. ", "license the software of use this work is under License version 2 copyright notice ", TEMPLATES["MIT"][2] + " "])
def test_a_million_letters_of_licence_words(part):
    import time

    start = time.process_time()
    licenses.scan(part * (1_000_000 // len(part)), INDEX)
    assert time.process_time() - start < 8


def test_tables_of_texts_with_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Licensed under CC BY 4.0.", "x"), (3, "Licensed under CC BY 4.0.", "x"), (None, "Licensed under CC BY 4.0.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((r.doc_id or 0, r.license, r.start, r.end) for r in licenses.scan_licenses(df).collect())
    assert got == [(0, "CC-BY-4.0", 0, 24)] + [(3, "CC-BY-4.0", 0, 24)] * 2
    assert licenses.scan_licenses(df.where("doc_id > 5")).count() == 0
