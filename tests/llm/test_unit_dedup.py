import random
import re

from hypothesis import given
from hypothesis import strategies as st

from stockloom.llm import unit_dedup


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def plain_units(text, least):
    """Lines, sentences, and the least runs of pieces from each short piece on and up to each; of equal ones that overlap the first."""
    out, row, at = set(), [], 0
    for line in (text or "").split("\n"):
        pieces, start = [], 0
        for cut in [m.end() for m in re.finditer(r"[.!?]+(?=[ \t\x0b\f\r])", line)] + [len(line)]:
            lead = len(line[start:cut]) - len(line[start:cut].lstrip())
            if line[start:cut].strip():
                pieces.append((start + lead, cut))
            start = cut
        row += [(at + a, at + b, plain_words(line[a:b])) for a, b in pieces if plain_words(line[a:b])]
        out |= {(at + a, at + b, " ".join(plain_words(line[a:b]))) for a, b in [*pieces, (0, len(line))] if len(plain_words(line[a:b])) >= least and (len(pieces) > 1 or (a, b) in pieces)}
        at += len(line) + 1
    for k, (_, _, words) in enumerate(row):
        if len(words) >= least:
            continue
        for runs in ([row[k:stop] for stop in range(k + 1, len(row) + 1)], [row[start : k + 1] for start in range(k, -1, -1)]):
            enough = [r for r in runs if sum(len(w) for *_, w in r) >= least]
            if enough:
                out.add((enough[0][0][0], enough[0][-1][1], " ".join(w for *_, words in enough[0] for w in words)))
    kept = []
    for a, b, digest in sorted(out):
        if all(d != digest or end <= a for _, end, d in kept):
            kept.append((a, b, digest))
    return kept


def brute(rows, least):
    seen, out = {}, set()
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in order:
        for a, b, digest in sorted(plain_units(text, least)):
            if digest in seen:
                out.add((doc_id, a, b, *seen[digest]))
            else:
                seen[digest] = (doc_id, a)
    return sorted(out, key=repr)


def rows():
    rng = random.Random(1)
    shared = [" ".join(f"s{k}w{j}" for j in range(rng.choice([3, 4, 9, 60]))) + "." for k in range(12)]
    out = []
    for k in range(60):
        lines = []
        for _ in range(rng.randrange(4)):
            lines.append(" ".join(rng.choice(shared).upper() if rng.random() < 0.5 else f"own{rng.random()} text here now." for _ in range(rng.randrange(1, 4))))
        out.append((k * 37 % 61, "\n".join(lines)))
    return out


ROWS = rows() + [(200, None), (201, ""), (202, "\n\n . \n"), (None, "A shared line of words, s0"), (203, "a SHARED  line\tof words, s0"), (204, "Twice here now, so. Twice here now, so."), (9999, "é ß long " * 3000), (10000, "É ß long " * 3000)]


def test_units_and_offsets():
    for _, text in ROWS:
        got = list(unit_dedup.units(text, 3))
        assert [u[:2] for u in got] == [u[:2] for u in plain_units(text, 3)]


def test_repeats_against_plain_loop(frame):
    docs = frame([(*r, 5, "d") for r in ROWS + ROWS[:5]], "doc_id long, text string, start int, digest string")
    got = sorted((tuple(r) for r in unit_dedup.report(docs, least=3).collect()), key=repr)
    assert got == brute(ROWS, 3)


def kept_units(rows, least):
    """Per document the units that others repeat."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, repeated = {}, set()
    for doc_id, text in order:
        for a, b, digest in plain_units(text, least):
            repeated |= {digest} if digest in seen else set()
            seen.setdefault(digest, (doc_id, a, b))
    return {d: seen[d] for d in repeated}


def check_cleaned(frame, rows, least):
    docs = frame([(*r, 5, "d") for r in rows], "doc_id long, text string, start int, removed string")
    spans, kept, texts = {}, kept_units(rows, least), []
    for doc_id, a, b, *_ in brute(rows, least):
        spans.setdefault(doc_id, set()).update(range(a, b))
    for doc_id, a, b in kept.values():
        if doc_id in spans:
            spans[doc_id] -= set(range(a, b))
    for r in unit_dedup.cleaned(docs, least=least).collect():
        text = r["row"]["text"]
        assert r["text"] == (text and "".join(c for k, c in enumerate(text) if k not in spans.get(r["row"]["doc_id"], ())))
        assert {k for s in r["removed"] for k in range(s["start"], s["end"])} == spans.get(r["row"]["doc_id"], set())
        texts.append(" ".join(plain_words(r["text"] or "")))
    for digest in kept:
        assert any(digest in t for t in texts)


def test_texts_without_the_repeats(frame):
    check_cleaned(frame, ROWS, 3)


def test_each_removed_unit_stands_whole_somewhere(frame):
    rng = random.Random(4)
    short = ["red fish swims", "no.", "one two. three", "a long enough line of eight words or more", "it is. so it is"]
    rows = [(k, "\n".join(rng.choice(short) for _ in range(rng.randrange(12)))) for k in range(40)]
    rows = list({t: (k, t) for k, t in rows}.values())
    for least in (3, 8):
        docs = frame(rows, "doc_id long, text string")
        assert sorted((tuple(r) for r in unit_dedup.report(docs, least=least).collect()), key=repr) == brute(rows, least)
        check_cleaned(frame, rows, least)


def test_a_text_that_repeats_itself(frame):
    got = unit_dedup.cleaned(frame([(1, "red fish swims\n" * 6)], "doc_id long, text string")).first()
    assert got["text"] == "red fish swims\n" * 3 + "\n"


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), max_size=8), st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), max_size=8))
def test_outside(spans, kept):
    of = lambda pairs: {k for a, n in pairs for k in range(a, a + n)}
    got = unit_dedup.outside([(a, a + n) for a, n in spans], [(a, a + n) for a, n in kept])
    assert [k for a, b in got for k in range(a, b)] == sorted(of(spans) - of(kept))


def test_empty(frame):
    assert unit_dedup.report(frame([], "doc_id long, text string")).count() == 0


def test_passage_of_short_lines_goes_whole(frame):
    verse = "So short\nthis is.\n\nA verse. Of lines,\nof few words\nA sentence between them that is long enough by itself\nthe end"
    rows = [(1, f"One begins\n{verse}\nand goes on here"), (2, f"Other words stand\n{verse}\nbefore and after"), (3, "A verse. Alone it stays, so short.")]
    got = {r["row"]["doc_id"]: r["text"] for r in unit_dedup.cleaned(frame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2].split() == "Other words stand before and after".split()
