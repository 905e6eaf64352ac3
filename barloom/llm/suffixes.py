"""Exact substring dedup with suffix arrays.

Two equal strings of SHARED bytes contain the same least GRAM bytes (by hash) at the same place. So each start of such a
string belongs to one anchor, the starts of an anchor form a region, and equal strings meet where the regions of equal
anchors meet. Texts are stored in blocks; a block posts each distinct region once, by hashes. Only anchors that occur
twice matter, and only where an anchor has different regions are these sent, each once. A bucket of regions is sorted
as one text in two stages: suffixes smaller than their successors directly, the rest induced by scans over the buckets
of first bytes; adjacent suffixes with a common prefix of SPAN bytes are repeats.

An anchor with over HOT different regions (a line that stands in many texts) would gather them in one place; its strings
are posted one by one instead, by 128-bit digests that spread over all buckets, each once for a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import bucket_count, cuts, from_ipc, in_blocks, ipc, mix64, pack, release_shuffles, spread, stored, table, table_of, text_bytes, unpack

#: Bytes of a string that is removed when it repeats, of one that counts as shared with another row (about 50 short
#: words), and of the hashed grams (a power of two).
SPAN, SHARED, GRAM = 400, 240, 64
#: Bytes of text in a block, and of those whose regions are found at a time, about.
BLOCK_BYTES, REGION_BYTES = 4 << 20, 1 << 20
#: Different regions of an anchor that are sorted together at most.
HOT = 1000
_U = np.uint64
_TABLE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
#: Marks of a region: it occurs again; in another row; its bytes are wanted; as digests.
MANY, CROSS, SEND, BY_DIGEST = 1, 2, 4, 8


def gram_hashes(joined: np.ndarray, size: int = GRAM, power: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash of joined[i:i+size] for each i; the last size-1 are of what is left."""
    h, power, n = _TABLE[joined], _U(power), 1
    with np.errstate(over="ignore"):
        while 2 * n <= size:
            shifted = np.zeros_like(h)
            shifted[:-n] = h[n:]
            h = h * power + shifted
            power = power * power
            n *= 2
        if n < size:  # the rest overlaps
            shifted = np.zeros_like(h)
            shifted[: n - size] = h[size - n :]
            h = mix64(h) * _U(0x9E3779B97F4A7C15) + shifted
    return mix64(h)


def regions(joined: np.ndarray, start: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, starts, anchor) of all regions: runs of starts with the same least gram in their span."""
    none = np.zeros(0, np.int64)
    n = len(joined)
    size = np.maximum(np.diff(start) - span + 1, 0)
    if not size.sum():
        return none, none, none, np.zeros(0, _U)
    h = gram_hashes(joined, gram)
    window = span - gram + 1
    place = np.arange(n, dtype=_U)
    key = (h & ~_U((1 << 24) - 1)) | (place & _U((1 << 24) - 1))
    whole = -(-n // window) * window
    key = np.concatenate([key, np.full(whole - n, ~_U(0))]).reshape(-1, window)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.repeat(start[:-1], size) + spread(size)
    least = np.minimum(behind[at], ahead[at + window - 1]) & _U((1 << 24) - 1)
    low = (at & ~((1 << 24) - 1)).astype(np.int64)
    anchor = low + least.astype(np.int64)
    anchor = np.where(anchor < at, anchor + (1 << 24), anchor)
    text = np.repeat(np.arange(len(size)), size)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], at[first], np.diff(np.append(first, len(at))), h[anchor[first]]


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = SPAN + 48) -> np.ndarray:
    """The wanted positions of text by their suffixes, as far as depth bytes tell, by two-stage sorting.

    Positions that only the induction needs (the falling runs after wanted ones) are sorted with them, and left out
    at the end."""
    n = len(text)
    if not wanted.any():
        return np.zeros(0, np.int64)
    # small: smaller than the successor; a run of equal bytes is as its end, the last one is larger than nothing
    edge = np.flatnonzero(np.diff(text)) + 1
    run = np.diff(np.concatenate([[0], edge, [n]]))
    rises = np.append(text[edge] > text[edge - 1], False)
    small = np.repeat(rises, run)
    following = np.where(small, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    falling = np.flatnonzero(wanted & ~small)
    mark = np.zeros(n + 2, np.int32)
    np.add.at(mark, falling, 1)
    np.add.at(mark, np.minimum(following[falling], n - 1) + 1, -1)
    need = (np.cumsum(mark)[:n] > 0) | wanted
    # stage one: the small suffixes directly, by eight bytes, then bytewise within ties
    raw = text.tobytes()
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n, 8), (1, 1))
    direct = np.flatnonzero(need & small)
    head = np.ascontiguousarray(eight[direct]).view(">u8").ravel().astype(_U)
    order = np.argsort(head, kind="stable")
    direct, head = direct[order], head[order]
    same = np.concatenate([[0], np.flatnonzero(np.diff(head)) + 1, [len(head)]]) if len(head) else np.zeros(1, np.int64)
    tie = np.flatnonzero(np.diff(same) > 1)
    for a, b in zip(same[tie].tolist(), same[tie + 1].tolist()):
        direct[a:b] = sorted(direct[a:b].tolist(), key=lambda i: raw[i + 8 : i + depth])
    # stage two: scan the buckets of first bytes in order; each scanned suffix puts its larger predecessor in place
    large = need & ~small
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if large[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[large[before]]
        if len(before):
            by = text[before]
            o = np.argsort(by, kind="stable")
            before, by = before[o], by[o]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(by)) + 1, [len(by)]])
            for a, b in zip(cut[:-1], cut[1:]):
                waiting[by[a]].append(before[a:b])

    out = []
    for c in range(256):
        done = 0
        while done < len(waiting[c]):
            fresh = np.concatenate(waiting[c][done:])
            done = len(waiting[c])
            out.append(fresh)
            induce(fresh)
        waiting[c] = []
        own = direct[bounds[c] : bounds[c + 1]]
        if len(own):
            out.append(own)
            induce(own)
    order = np.concatenate(out)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = SPAN) -> np.ndarray:
    """For each two neighbours in order the length of their common prefix, at most `most` bytes."""
    padded = np.concatenate([text, np.zeros(most + 8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(text) + most, 8), (1, 1))
    length = np.full(max(len(order) - 1, 0), most, np.int64)
    alive = np.arange(len(length))
    for at in range(0, most, 8):
        a = np.ascontiguousarray(eight[order[alive] + at]).view("<u8").ravel()
        b = np.ascontiguousarray(eight[order[alive + 1] + at]).view("<u8").ravel()
        off = a ^ b
        out = np.flatnonzero(off)
        low = off[out] & (~off[out] + _U(1))
        length[alive[out]] = np.minimum(at + np.floor(np.log2(low.astype(np.float64))).astype(np.int64) // 8, most)
        alive = alive[off == 0]
        if not len(alive):
            break
    return length


def classes(text: np.ndarray, wanted: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The wanted positions in suffix order, and for each length the numbers of their classes: positions are in one
    class if they begin with as many equal bytes."""
    order = suffix_order(text, wanted, max(lengths) + 48)
    common = common_prefixes(text, order, max(lengths))
    return order, [np.concatenate([[0], np.cumsum(common < n)])[: len(order)] for n in lengths]


_ASKED = pa.struct([("bucket", pa.int32()), ("at", pa.int32()), ("regions", pa.binary())])
_BLOCK = pa.schema([("block", pa.int64()), ("texts", pa.binary()), ("regions", pa.binary()), ("asked", pa.list_(_ASKED))])
_BLOCK_SQL = "block long, texts binary, regions binary, asked array<struct<bucket:int,at:int,regions:binary>>"
#: A distinct region of a block: anchor, hash of its bytes, whether it occurs again there (MANY), in another row (CROSS).
_ASKED_KINDS = (_U, _U, "u1")
#: An occurrence of a region: number of the distinct region, row, first start in the text, starts.
_REGION_KINDS = ("<u4", "<u4", "<u4", "<u4")
_ANSWER = pa.schema([("block", pa.int64()), ("numbers", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("at", pa.int32()), ("header", pa.binary()), ("blob", pa.binary())])
#: A sent region: its number, marks, row, starts and bytes; a sent digest: its two halves, length and marks.
_HEADER_KINDS = ("<u4", "u1", "<u4", "<u4", "<u4")
_DIGEST_KINDS = (_U, _U, "u1", "u1")
_RESULT = pa.schema([("block", pa.int64()), ("runs", pa.binary()), ("digests", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_shared", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _block(number: int, rows: pa.Table, span: int, shared: int, gram: int, buckets: int) -> tuple:
    """A block's texts, its regions, and what it posts to each bucket."""
    column = rows["text"].combine_chunks()
    joined, start = text_bytes(column)
    raw, end = joined.tobytes(), start[1:]
    found = []  # by runs of rows, for bounded arrays
    for a, b in cuts(start[:-1] // REGION_BYTES):
        r, f, n, h = regions(joined[start[a] : start[b]], start[a : b + 1] - start[a], min(span, shared), gram)
        found.append((r + a, f + start[a], n, h))
    row, first, starts, anchor = (np.concatenate(x) for x in zip(*found))
    last = np.minimum(first + starts - 1 + span, end[row]) if len(row) else first
    digest = xxhash.xxh3_64_intdigest
    content = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), last.tolist())], _U)
    bucket = (anchor % _U(buckets)).astype(np.int64)
    order = np.lexsort((row, content, anchor, bucket))
    row, first, starts, anchor, content, bucket = (x[order] for x in (row, first - start[row], starts, anchor, content, bucket))
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(row))[: len(a)] - 1
    marks = ((z > a) * MANY + (row[z] != row[a]) * CROSS).astype(np.uint8)
    asked = [{"bucket": int(bucket[a[x]]), "at": x, "regions": pack(anchor[a[x:y]], content[a[x:y]], marks[x:y])} for x, y in cuts(bucket[a])]
    kept = pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), column.cast(pa.large_string())], ["doc_id", "text"])
    return number, ipc(kept), pack(*(x.astype("<u4") for x in (np.cumsum(new) - 1, row, first, starts))), asked


def _meet(rows: pa.Table, hot: int) -> pa.Table:
    """For each block of a bucket its regions whose anchors occur again, with their marks."""
    blocks, at, packed = (rows[c].to_pylist() for c in ("block", "at", "regions"))
    parts = [unpack(x, *_ASKED_KINDS) for x in packed]
    size = [len(x[0]) for x in parts]
    anchor, content, marks = (np.concatenate(x) for x in zip(*parts))
    block = np.repeat(np.array(blocks, np.int64), size)
    number = np.concatenate([np.arange(a, a + n) for a, n in zip(at, size)])
    order = np.lexsort((block, content, anchor))
    anchor, content, marks, block, number = (x[order] for x in (anchor, content, marks, block, number))
    new_a = np.ones(len(anchor), bool)
    new_a[1:] = anchor[1:] != anchor[:-1]
    new_c = new_a.copy()
    new_c[1:] |= content[1:] != content[:-1]
    by_a, by_c = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
    entries_a, entries_c = np.bincount(by_a), np.bincount(by_c)
    again = (entries_a > 1) | (np.bincount(by_a, marks & MANY) > 0)
    different = np.bincount(by_a, new_c).astype(np.int64)
    own = np.maximum.reduceat(marks, np.flatnonzero(new_c)) | (entries_c > 1) * np.uint8(MANY | CROSS)
    marks = own[by_c] | (new_c & (different[by_a] > 1)) * np.uint8(SEND) | (different[by_a] > hot) * np.uint8(BY_DIGEST)
    keep = again[by_a]
    block, number, marks = block[keep], number[keep].astype("<u4"), marks[keep].astype(np.uint8)
    order = np.argsort(block, kind="stable")
    block, number, marks = block[order], number[order], marks[order]
    return table_of([(int(block[a]), pack(number[a:b], marks[a:b])) for a, b in cuts(block)], _ANSWER)


class _Block:
    """A stored block with the marks of its distinct regions."""

    def __init__(self, row: dict, answers: list[bytes]):
        texts = from_ipc(row["texts"])
        self.ids = texts["doc_id"]
        self.joined, self.start = text_bytes(texts["text"].combine_chunks())
        self.of, self.row, self.first, self.starts = (x.astype(np.int64) for x in unpack(row["regions"], *_REGION_KINDS))
        self.marks = np.zeros(int(self.of[-1]) + 1 if len(self.of) else 0, np.uint8)
        for x in answers:
            number, marks = unpack(x, "<u4", "u1")
            self.marks[number] = marks

    def chosen(self, by_digest: bool, span: int) -> tuple[np.ndarray, ...]:
        """(number, place of the first byte, bytes, row) of the regions to send, one occurrence of each."""
        want = (self.marks & SEND > 0) & ((self.marks & BY_DIGEST > 0) == by_digest)
        number = np.flatnonzero(want)
        i = np.searchsorted(self.of, number)
        place = self.start[self.row[i]] + self.first[i]
        size = np.minimum(place + self.starts[i] - 1 + span, self.start[self.row[i] + 1]) - place
        return number, place, size, i

    def digests(self, span: int, shared: int, buckets: int) -> tuple[np.ndarray, ...]:
        """Of the regions that go by digest: (bucket, two halves, length's number, marks) of each distinct string, in
        the order of buckets, and (number of the distinct string, region, offset, length's number) of each string."""
        number, place, size, i = self.chosen(True, span)
        starts = self.starts[i]
        at = np.cumsum(size) - size
        text = self.joined[np.repeat(place, size) + spread(size)]
        items = []
        for k, n in enumerate((span, shared)):
            who, offset = np.repeat(np.arange(len(number)), starts), spread(starts)
            whole = offset + n <= size[who]
            who, offset = who[whole], offset[whole]
            p = at[who] + offset
            items.append((gram_hashes(text, n)[p], gram_hashes(text, n, 0xA0761D6478BD642F)[p], np.full(len(p), k, np.uint8), who, offset))
        x, y, k, who, offset = (np.concatenate(z) for z in zip(*items))
        bucket = (x % _U(buckets)).astype(np.int64)
        order = np.lexsort((self.row[i][who], k, y, x, bucket))
        x, y, k, who, offset, bucket = (z[order] for z in (x, y, k, who, offset, bucket))
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (k[1:] != k[:-1])
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(x))[: len(a)] - 1
        own = np.maximum.reduceat(self.marks[number[who]] & (MANY | CROSS), a) if len(a) else np.zeros(0, np.uint8)
        rows = self.row[i][who]
        marks = (own | (z > a) * np.uint8(MANY) | (rows[z] != rows[a]) * np.uint8(CROSS)).astype(np.uint8)
        return (bucket[a], x[a], y[a], k[a], marks), (np.cumsum(new) - 1, number[who], offset, k)


def _send(blocks: pa.Table, answers: pa.Table, span: int, shared: int, buckets: int) -> pa.Table:
    """The bytes of the wanted regions, and the digests of the strings of those that go by digest, by bucket."""
    out = []
    for row in blocks.to_pylist():
        b = _Block(row, answers["numbers"].to_pylist())
        raw = b.joined.tobytes()
        number, place, size, i = b.chosen(False, span)
        # numbers are in the order of anchors' buckets; those of each are known from where the block's postings begin
        to = np.searchsorted(np.array([x["at"] for x in row["asked"]]), number, side="right") - 1
        for x, y in cuts(to):
            blob = b"".join(raw[p : p + n] for p, n in zip(place[x:y].tolist(), size[x:y].tolist()))
            header = pack(number[x:y].astype("<u4"), b.marks[number[x:y]], b.row[i[x:y]].astype("<u4"), b.starts[i[x:y]].astype("<u4"), size[x:y].astype("<u4"))
            out.append((row["asked"][to[x]]["bucket"], row["block"], None, header, blob))
        if (b.marks & BY_DIGEST).any():
            (bucket, *columns), _ = b.digests(span, shared, buckets)
            out += [(int(bucket[x]), row["block"], x, pack(*(c[x:y] for c in columns)), None) for x, y in cuts(bucket)]
    return table_of(out, _SENT)


def _sort(rows: pa.Table, span: int, shared: int) -> pa.Table:
    """What repeats in a bucket: runs of starts of the sent regions, and digests, by block."""
    blocks, at, headers, blobs = (rows[c].to_pylist() for c in ("block", "at", "header", "blob"))
    out = []
    sent = [i for i, x in enumerate(blobs) if x is not None]
    if sent:
        parts = [unpack(headers[i], *_HEADER_KINDS) for i in sent]
        number, marks, row, starts, size = (np.concatenate(x) for x in zip(*parts))
        block = np.repeat(np.array([blocks[i] for i in sent], np.int64), [len(x[0]) for x in parts])
        starts, size = starts.astype(np.int64), size.astype(np.int64)
        text = np.frombuffer(b"".join(blobs[i] for i in sent), np.uint8)
        begin = np.cumsum(size) - size
        owner, offset = np.repeat(np.arange(len(size)), starts), spread(starts)
        wanted = np.zeros(len(text), bool)
        wanted[begin[owner] + offset] = True
        order, (far, near) = classes(text, wanted, (span, shared))
        which = np.zeros(len(text), np.int64)
        which[begin[owner] + offset] = np.arange(len(owner))
        which = which[order]
        runs = []
        for kind, n, cls in ((0, span, far), (1, shared, near)):
            true = offset[which] + n <= size[owner[which]]
            w, cls = which[true], cls[true]
            if not len(w):
                continue
            first = np.flatnonzero(np.concatenate([[True], np.diff(cls) > 0]))
            many = np.diff(np.append(first, len(cls)))
            if kind:  # in several rows: another block or row, or a region that has several
                rank = np.unique(np.stack([block, row.astype(np.int64)], 1), axis=0, return_inverse=True)[1].reshape(-1)[owner[w]]
                again = (np.minimum.reduceat(rank, first) != np.maximum.reduceat(rank, first)) | (np.maximum.reduceat(marks[owner[w]] & CROSS, first) > 0)
                told = marks[owner[w]] & CROSS > 0
            else:
                again, told = many > 1, marks[owner[w]] & MANY > 0
            w = np.sort(w[np.repeat(again, many) & ~told])  # of the others the blocks know already
            if len(w):
                new = np.concatenate([[True], (np.diff(w) > 1) | (np.diff(owner[w]) > 0)])
                a = np.flatnonzero(new)
                z = np.append(a[1:], len(w)) - 1
                runs.append((owner[w[a]], offset[w[a]], offset[w[z]], np.full(len(a), kind, np.uint8)))
        if runs:
            o, low, high, kind = (np.concatenate(x) for x in zip(*runs))
            order = np.argsort(block[o], kind="stable")
            o, low, high, kind = o[order], low[order], high[order], kind[order]
            out += [(int(block[o[x]]), pack(number[o[x:y]], low[x:y].astype("<u4"), high[x:y].astype("<u4"), kind[x:y]), None) for x, y in cuts(block[o])]
    posted = [i for i, x in enumerate(blobs) if x is None]
    if posted:
        parts = [unpack(headers[i], *_DIGEST_KINDS) for i in posted]
        length = [len(x[0]) for x in parts]
        x, y, k, marks = (np.concatenate(z) for z in zip(*parts))
        block = np.repeat(np.array([blocks[i] for i in posted], np.int64), length)
        number = np.concatenate([np.arange(at[i], at[i] + n) for i, n in zip(posted, length)]).astype("<u4")
        order = np.lexsort((block, k, y, x))
        x, y, k, marks, block, number = (z[order] for z in (x, y, k, marks, block, number))
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (k[1:] != k[:-1])
        group = np.cumsum(new) - 1
        again = (np.bincount(group) > 1)[group] | (marks & np.where(k > 0, CROSS, MANY).astype(np.uint8) > 0)
        block, number = block[again], number[again]
        order = np.argsort(block, kind="stable")
        block, number = block[order], number[order]
        out += [(int(block[a]), None, pack(number[a:b])) for a, b in cuts(block)]
    return table_of(out, _RESULT)


def _cut(blocks: pa.Table, told: pa.Table, span: int, shared: int, buckets: int) -> pa.Table:
    """What stays of a block's texts. told: answers and results."""
    out = []
    for row in blocks.to_pylist():
        b = _Block(row, [x for x in told["numbers"].to_pylist() if x is not None])
        runs = [unpack(x, "<u4", "<u4", "<u4", "u1") for x in told["runs"].to_pylist() if x is not None]
        if any(x is not None for x in told["digests"].to_pylist()):
            distinct, (of, number, offset, kind) = b.digests(span, shared, buckets)
            again = np.zeros(len(distinct[0]), bool)
            for x in told["digests"].to_pylist():
                if x is not None:
                    again[unpack(x, "<u4")[0]] = True
            hit = again[of]
            runs.append((number[hit], offset[hit], offset[hit], kind[hit]))
        for kind, mark in ((0, MANY), (1, CROSS)):
            whole = np.flatnonzero(b.marks & mark)
            runs.append((whole, np.zeros(len(whole), np.int64), np.full(len(whole), 1 << 31), np.full(len(whole), kind)))
        number, low, high, kind = (np.concatenate([np.asarray(y, np.int64) for y in x]) for x in zip(*runs))
        a, z = np.searchsorted(b.of, number), np.searchsorted(b.of, number, side="right")
        times = z - a
        i = np.repeat(a, times) + spread(times)  # every occurrence of the region
        low, high, kind = (np.repeat(x, times) for x in (low, high, kind))
        place, end = b.start[b.row[i]] + b.first[i], b.start[b.row[i] + 1]
        covers = []
        for k, n in enumerate((span, shared)):
            first, last = place + low, np.minimum(place + np.minimum(high, b.starts[i] - 1), end - n) + n
            use = (kind == k) & (last - n >= first)
            mark = np.zeros(len(b.joined) + 1, np.int32)
            np.add.at(mark, first[use], 1)
            np.add.at(mark, last[use], -1)
            covers.append(np.cumsum(mark)[:-1] > 0)
        gone, common = covers
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edge = b.start[:-1][np.diff(b.start) > 0]
        opens[edge] = gone[edge]
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        per_row = lambda x: np.diff(upto(x)[b.start])
        kept, at = b.joined[~gone].tobytes(), upto(~gone)[b.start]
        pieces = [kept[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        out.append(pa.Table.from_arrays([b.ids.combine_chunks(), *(pa.array(x, pa.int64()) for x in (np.diff(b.start), per_row(gone), per_row(opens), per_row(common))), pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string()), pa.array(pieces, pa.binary())], schema=_OUT))
    return pa.concat_tables(out) if out else _OUT.empty_table()


def repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", shared: int = SHARED, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_shared, kept_sha256, kept binary) for every row of docs.

    Removed is each byte covered by a span-byte string that also starts anywhere else, in the same text or another,
    as the input stands; n_spans counts maximal removed runs. n_shared counts the bytes covered by a shared-byte string
    (shared is at most span) that also starts in another row: shorter passages show there, and repeats within one text
    do not. Null texts count as empty; rows with equal ids are rows of their own, and equal rows are each other's
    repeats; a null id is an id as any other; no rows give none. Other columns are not looked at.
    """
    if not gram < shared <= span:
        raise ValueError("gram must be smaller than shared, shared at most span")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = 4 * bucket_count(base)  # a bucket's sorting takes sixty bytes for each byte of its regions
    blocks = stored(in_blocks(base, lambda number, rows: _block(number, rows, span, shared, gram, buckets), _BLOCK, _BLOCK_SQL, BLOCK_BYTES), "blocks")
    asked = blocks.select("block", F.explode("asked").alias("x")).select("block", "x.bucket", "x.at", "x.regions")
    answers = stored(asked.groupBy("bucket").applyInArrow(lambda rows: _meet(rows, hot), "block long, numbers binary"), "answers")
    light = blocks.select("block", "texts", "regions", F.transform("asked", lambda x: x.dropFields("regions")).alias("asked"))
    sent = light.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda x, y: _send(x, y, span, shared, buckets), "bucket int, block long, at int, header binary, blob binary")
    results = sent.groupBy("bucket").applyInArrow(lambda rows: _sort(rows, span, shared), "block long, runs binary, digests binary")
    told = answers.unionByName(stored(results, "results"), allowMissingColumns=True)
    release_shuffles(docs.sparkSession)
    return (
        blocks.select("block", "texts", "regions").groupBy("block").cogroup(told.groupBy("block"))
        .applyInArrow(lambda x, y: _cut(x, y, span, shared, buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, n_shared long, kept_sha256 string, kept binary")
    )


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("kept")
