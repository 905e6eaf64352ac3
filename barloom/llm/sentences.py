"""Substring dedup by sliding sentence spans.

From every sentence, forwards and backwards, the shortest run that has two sentences and LEAST_WORDS words is hashed.
The runs meet by their hashes; of a run that occurs more than once the first occurrence (least document, then place)
stays, and the sentences that any other occurrence covers are removed. A repeated passage of two and more sentences
with enough words consists of such runs, so none of its sentences is missed, however short they are.

Texts are stored in blocks. A block sends each distinct run once, with the run's first occurrence in the block, to the
bucket of its hash; the bucket answers the blocks that hold runs which occur again. So a run that stands in a third of
all documents costs one posting for each block, not for each document.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import bucket_count, cuts, from_ipc, in_blocks, ipc, pack, stored, table, table_of, unpack

#: Sentences of a passage that counts (two do as well; 1 lets single ones count), and words it must have.
SPAN, LEAST_WORDS = 3, 10
#: Words that a stretch of sentences must have to count as shared with another row.
SHARED_WORDS = 15
#: A sentence with the blanks after it: up to . ! or ? before a blank, or to the end of a line. Fixed pattern.
_SENTENCE = re.compile(r"(?:[^.!?\n]++|[.!?](?!\s|$))*+(?:[.!?]+(?=\s|$)|\n|$)\s*")
_WORD = re.compile(r"\w+")
_U = np.uint64
#: Marks of a run in an answer: its first occurrence of all is in this block; it stands in several rows.
FIRST, SHARED = 1, 2


def split(text: str | None) -> list[str]:
    """The sentences of a text with what follows them; together they are the text. None and "" have none."""
    return [m[0] for m in _SENTENCE.finditer(text or "") if m[0]]


def plain(sentence: str) -> str:
    """What makes sentences equal: their words in lower case."""
    return " ".join(_WORD.findall(sentence.lower()))


def run_hashes(sentences: list[str], span: int, least: int) -> list[tuple[int, int, int]]:
    """(hash, place, sentences) of each run: the fewest sentences with words, two at least, that have least words, from
    and up to every sentence; of a text with one sentence that one. Longer runs, those of span sentences too, consist
    of these. Sentences without words belong to the run around them."""
    own = [(i, p) for i, p in ((i, plain(s)) for i, s in enumerate(sentences)) if p]
    fewest = min(2, span, len(own))
    so_far = [0]
    for _, p in own:
        so_far.append(so_far[-1] + p.count(" ") + 1)
    if not own or so_far[-1] < least:
        return []
    ends = ((a, max(a + fewest, bisect_left(so_far, so_far[a] + least))) for a in range(len(own)))
    begins = ((min(b - fewest, bisect_right(so_far, so_far[b] - least) - 1), b) for b in range(1, len(own) + 1))
    out = []
    for a, b in sorted({(a, b) for a, b in (*ends, *begins) if a >= 0 and b <= len(own)}):
        first, last = own[a][0], own[b - 1][0]
        out.append((xxhash.xxh3_64_intdigest("\n".join(p for _, p in own[a:b])) - (1 << 63), first, last - first + 1))
    return out


_ASKED = pa.struct([("bucket", pa.int32()), ("at", pa.int32()), ("runs", pa.binary())])
_BLOCK = pa.schema([("block", pa.int64()), ("texts", pa.binary()), ("runs", pa.binary()), ("asked", pa.list_(_ASKED))])
_BLOCK_SQL = "block long, texts binary, runs binary, asked array<struct<bucket:int,at:int,runs:binary>>"
#: A distinct run of a block: hash, id, text and place of its first occurrence there, whether it occurs again there
#: (1), and in another row of the block (2).
_ASKED_KINDS = ("<u8", "<i8", "<u8", "<u4", "u1")
#: An occurrence of a run: number of the distinct run, row, place, sentences, whether it is the block's first one.
_RUN_KINDS = ("<u4", "<u4", "<u4", "<u4", "u1")
_ANSWER = pa.schema([("block", pa.int64()), ("answer", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int32()), ("n_removed", pa.int32()), ("n_shared", pa.int32()), ("removed", pa.list_(pa.int32())), ("text", pa.string())])


def _block(number: int, rows: pa.Table, span: int, least: int, buckets: int) -> tuple:
    """A block's texts, its runs, and what it asks each bucket."""
    texts = rows["text"].to_pylist()
    counts, found = [], []
    for r, text in enumerate(texts):
        sentences = split(text)
        counts.append(len(sentences))
        found += [(h + (1 << 63), r, place, n) for h, place, n in run_hashes(sentences, span, least)]
    c = list(zip(*found)) or [()] * 4
    h, row, place, n = (np.array(x, k) for x, k in zip(c, (_U, "<u4", "<u4", "<u4")))
    ids = np.array([-(2**63) if i is None else i for i in rows["doc_id"].to_pylist()], np.int64)
    digest = np.array([xxhash.xxh3_64_intdigest(t or "") for t in texts], _U)
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((digest, ids))] = np.arange(len(ids))
    bucket = (h % _U(buckets)).astype(np.int64)
    order = np.lexsort((place, rank[row], h, bucket))
    h, row, place, n, bucket = h[order], row[order], place[order], n[order], bucket[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h))[: len(first)] - 1
    flags = ((last > first) | (row[last] != row[first]).astype(np.uint8) * 2).astype(np.uint8)
    asked = (h[first], ids[row[first]], digest[row[first]], place[first], flags)
    out = [{"bucket": int(bucket[first[a]]), "at": a, "runs": pack(*(x[a:b] for x in asked))} for a, b in cuts(bucket[first])]
    kept = pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), rows["text"].combine_chunks().cast(pa.large_string()), pa.array(counts, pa.int32())], ["doc_id", "text", "n"])
    return number, ipc(kept), pack((np.cumsum(new) - 1).astype("<u4"), row, place, n, new.astype(np.uint8)), out


def _answer(rows: pa.Table) -> pa.Table:
    """For each block of a bucket the runs that occur again, with their marks."""
    blocks, at, packed = (rows[c].to_pylist() for c in ("block", "at", "runs"))
    parts = [unpack(x, *_ASKED_KINDS) for x in packed]
    size = [len(x[0]) for x in parts]
    h, doc, text, place, flags = (np.concatenate(x) for x in zip(*parts))
    block = np.repeat(np.array(blocks, np.int64), size)
    number = np.concatenate([np.arange(a, a + n) for a, n in zip(at, size)])
    order = np.lexsort((block, place, text, doc, h))
    h, block, number, flags = h[order], block[order], number[order], flags[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
    many = np.diff(np.append(start, len(h)))
    several = np.repeat(many > 1, many)
    rows_too = np.repeat(np.maximum.reduceat(flags, start) >= SHARED, many)
    mark = np.where(several | rows_too, SHARED, 0).astype(np.uint8)
    mark[start] |= FIRST
    again = several | (flags > 0)
    block, number, mark = block[again], number[again], mark[again]
    order = np.argsort(block, kind="stable")
    block, number, mark = block[order], number[order].astype("<u4"), mark[order]
    return table_of([(int(block[a]), pack(number[a:b], mark[a:b])) for a, b in cuts(block)], _ANSWER)


def _cut(block: pa.Table, answers: pa.Table) -> pa.Table:
    """What stays of a block's texts."""
    out = []
    for raw, runs in zip(block["texts"].to_pylist(), block["runs"].to_pylist()):
        texts = from_ipc(raw)
        of, row, place, n, own_first = unpack(runs, *_RUN_KINDS)
        mark = np.full(int(of.max()) + 1 if len(of) else 0, 255, np.uint8)
        for x in answers["answer"].to_pylist():
            number, marks = unpack(x, "<u4", "u1")
            mark[number] = marks
        mark = mark[of]
        gone = (mark != 255) & ~((mark & FIRST > 0) & (own_first > 0))
        shared = (mark != 255) & (mark & SHARED > 0)
        used = np.flatnonzero(gone | shared)
        used = used[np.argsort(row[used], kind="stable")]
        of_row = {int(row[used[a]]): used[a:b] for a, b in cuts(row[used])}
        for r, (i, text, count) in enumerate(zip(*(texts[c].to_pylist() for c in ("doc_id", "text", "n")))):
            runs_of = of_row.get(r)
            if runs_of is None:
                out.append((i, count, 0, 0, [], text))
                continue
            cover = np.zeros((2, count + 1), bool)
            for k in runs_of.tolist():
                a, b = int(place[k]), int(place[k]) + int(n[k])
                cover[0, a:b] |= gone[k]
                cover[1, a:b] |= shared[k]
            sentences = split(text)
            removed = np.flatnonzero(cover[0]).tolist()
            kept = "".join(s for s, m in zip(sentences, cover[0]) if not m) if removed else text
            stretches = [(a, b) for a, b in cuts(cover[1]) if cover[1, a]]
            n_shared = sum(b - a for a, b in stretches if sum(len(_WORD.findall(s)) for s in sentences[a:b]) >= SHARED_WORDS)
            out.append((i, count, len(removed), n_shared, removed, kept))
    return table_of(out, _OUT)


def span_dedup(docs: DataFrame, span: int = SPAN, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_removed, n_shared, removed array<int>, text) for every row of docs: removed are the
    places of the sentences (from 0) that a repeated run other than its first occurrence covers, text is what stays.
    n_shared counts the sentences of stretches of SHARED_WORDS words and more that runs cover which other rows have
    too, first occurrences included: it tells what is shared, where n_removed tells what goes.

    A run is two sentences in a row, or as many more as it takes to have least words (the one sentence of a text with
    one); with span 1 single sentences are runs as well. Runs are equal if their words are, whatever their case and
    the blanks and signs between them. First is the least doc_id, then the row with the least hash of its text, then
    the least place; a null id comes before all numbers. Equal rows are each other's repeats. Null texts count as
    empty and stay null. No rows give none. Other columns are not looked at.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = bucket_count(base)
    blocks = stored(in_blocks(base, lambda number, rows: _block(number, rows, span, least, buckets), _BLOCK, _BLOCK_SQL), "blocks")
    asked = blocks.select("block", F.explode("asked").alias("x")).select("block", "x.bucket", "x.at", "x.runs")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "block long, answer binary")
    return (
        blocks.select("block", "texts", "runs").groupBy("block").cogroup(answers.groupBy("block"))
        .applyInArrow(_cut, "doc_id long, n_sentences int, n_removed int, n_shared int, removed array<int>, text string")
    )


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sentence-span dedup leaves of every document."""
    return span_dedup(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
