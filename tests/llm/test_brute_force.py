"""Chunks, sentence spans and alignments against plain loops that share no code with the operators."""

import collections
import random
import re

import numpy as np

from barloom.llm import fingerprint, licenses, sentences

rng = random.Random(7)
SIGNS = [". ", "! ", "?! ", ".\n", "\n", " ", " ", " ", "  ", "3.5 ", "... "]


def text_of(n: int) -> str:
    return "".join(rng.choice("the old mill river Ä ñandú 水 stone BRIDGE".split()) + rng.choice(SIGNS) for _ in range(n))


# --- chunks ---


def cut(raw: bytes) -> list[int]:
    """Ends of the chunks, byte by byte."""
    ends, at, rolled = [], 0, 0
    for i, byte in enumerate(raw):
        rolled = (rolled * 2 + int(fingerprint._GEAR[byte])) % 65536
        size = i + 1 - at
        mask = 0b1111111 << 9 if size < fingerprint.NORMAL else 0b1111 << 12
        if size >= fingerprint.LEAST and not rolled & mask or size == fingerprint.MOST:
            ends.append(i + 1)
            at = i + 1
    return ends if at == len(raw) else [*ends, len(raw)]


def likeness(a: bytes, b: bytes) -> float:
    pieces = [{raw[x:y] for x, y in zip([0, *ends], ends)} for raw, ends in ((a, cut(a)), (b, cut(b)))]
    return sum(len(x) for x in pieces[0] & pieces[1]) / sum(map(len, pieces[0])) if a else float(not b)


def test_chunks_byte_by_byte():
    raw = [text_of(rng.randint(0, 120)).encode() for _ in range(200)] + [b"", b"x", b"a" * 1000, bytes(range(32, 127)) * 9]
    start = np.cumsum([0, *map(len, raw)])
    got = fingerprint.chunk_ends(np.frombuffer(b"".join(raw), np.uint8), start)
    assert [[e - a for e in ends] for a, ends in zip(start.tolist(), got)] == [cut(x) for x in raw]


def test_likeness_by_whole_chunks(spark):
    texts = ["", "", *[text_of(rng.randint(1, 150)) for _ in range(40)]]
    texts += [texts[5], texts[6] + texts[7]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprint.compare_with_edits(docs).collect():
        text, other = texts[r.doc_id], texts[r.doc_id - 1]
        n = len(text) // 3
        edited = text[: len(text) - n] + other[:n]
        assert np.isclose(r.near_edited, likeness(text.encode(), edited.encode()))
        assert np.isclose(r.near_next, likeness(text.encode(), other.encode()))


# --- sentence spans ---


def sentences_of(text: str) -> list[str]:
    """Up to a sign before a blank or the end, or a line's end; blanks after it belong to it."""
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text):
            j += 1
            if text[j - 1] == "\n" or text[j - 1] in ".!?" and (j == len(text) or text[j].isspace()):
                break
        while j < len(text) and text[j].isspace():
            j += 1
        out.append(text[i:j])
        i = j
    return out


def runs_of(parts: list[str], least: int) -> list[tuple[int, int, tuple]]:
    """(first sentence, last sentence, words) of the shortest runs from and up to each sentence with words."""
    own = [(i, tuple(re.findall(r"\w+", p.lower()))) for i, p in enumerate(parts) if re.search(r"\w", p)]
    fewest, found = min(2, len(own)), set()
    enough = lambda a, b: sum(len(w) for _, w in own[a:b]) >= least
    for a in range(len(own)):
        found.update([(a, b) for b in range(a + fewest, len(own) + 1) if enough(a, b)][:1])
    for b in range(fewest, len(own) + 1):
        found.update([(a, b) for a in range(b - fewest, -1, -1) if enough(a, b)][:1])
    return [(own[a][0], own[b - 1][0], tuple(w for _, w in own[a:b])) for a, b in sorted(found)]


def test_spans_with_an_own_splitter(spark):
    passages = [text_of(rng.randint(8, 40)) + ". " for _ in range(6)]
    texts = ["", "...", "\n\n", "One sentence of ten words stands here all by itself."] * 2
    texts += ["".join(rng.choice([text_of(12) + ". ", rng.choice(passages)]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    seen, gone = set(), collections.defaultdict(set)
    for i, text in enumerate(texts):
        parts = sentences_of(text)
        assert "".join(parts) == text and parts == sentences.split(text)
        for first, last, words in runs_of(parts, 10):
            if words in seen:
                gone[i].update(range(first, last + 1))
            seen.add(words)
    got = sentences.span_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in got} == {i: sorted(gone[i]) for i in range(len(texts))} and len(gone) > 20


# --- licences ---


def longest(a: list, b: list) -> int:
    """Length of the longest common subsequence, in quadratic time."""
    row = [0] * (len(b) + 1)
    for x in a:
        row, before = [0], row
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
    return row[-1]


def test_alignment_against_the_longest_common_subsequence():
    for _ in range(300):
        words = range(rng.randint(1, 30))
        a, b = (rng.sample(words, rng.randint(0, len(words))) for _ in range(2))
        assert len(licenses.align(a, b)) == longest(a, b)  # without repeated words patience finds the longest one
        a, b = ([rng.choice(words) for _ in range(rng.randint(0, 40))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= longest(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_edited_templates_are_found(spark):
    template = [f"t{i}" for i in range(20)]
    rows, want = [], {}
    for d in range(120):
        lost = rng.randint(0, 7)
        kept = sorted(rng.sample(range(20), 20 - lost))
        body = [template[i].upper() if rng.random() < 0.3 else template[i] for i in kept]
        for _ in range(rng.randint(0, 5)):
            body.insert(rng.randint(1, len(body) - 1), "filler")
        before = " ".join(["word"] * rng.randint(1, 50)) + " "
        rows.append((d, before + ", ".join(body) + " end " * rng.randint(1, 50)))
        if lost <= 4:
            want[d] = (len(before), len(before) + len(", ".join(body)), (20 - lost) / 20)
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), [("mine", " ".join(template))]).collect()
    assert {r.doc_id: (r.start, r.end, r.coverage) for r in got} == want and len(got) == len(want)
