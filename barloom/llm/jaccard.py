"""Jaccard join of word n-gram sets by universe partition.

The shingles of a set are hashed into segments, as many as two sets of the size band may differ by, plus one: then two
similar sets agree on a segment. Some segments are also indexed by their one-deletion neighbourhoods; agreeing on none
of those takes two differences, so they count twice. Which bands take them is decided by cost: a first pass counts, for
one segment of each kind, how long the lists of all sets are. How far down the list of segments each set goes follows
from its empty segments (the cost of an empty segment's long list is never paid but by the few sets that have no other
choice). Candidates are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import bucket_count, discard, hash64, mix64, partitions, slices, spread, stored, table, words
from barloom.llm.components import components

WIDTH, PERCENT = 5, 80
_U = np.uint64
#: What a pair of candidates costs, in signatures.
PAIR_COST = 4
#: Members of a list that are paired with each other as they are; longer lists are stars, whose members are compared by
#: bit maps of MAP_BITS at most, in tiles of TILE by TILE.
PAIRED, MAP_BITS, TILE = 16, 1024, 4096
#: Partners of a document that one verification group holds, about.
GROUP_PARTNERS = 256


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingles, sorted within each text, and where each text's begin (one more than texts).

    A shingle is width words in a row; of fewer words all of them; of none nothing."""
    code, distinct, begin = words(texts)
    w = mix64(hash64(distinct))[code] if len(code) else np.zeros(0, _U)
    n = np.diff(begin)
    full = np.maximum(n - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), full)
    at = np.repeat(begin[:-1], full) + spread(full)
    h = np.zeros(len(at), _U)
    for j in range(width):
        h = mix64(h + w[at + j] + _U(j + 1))
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        extra = np.zeros(len(short), _U)
        for j in range(width - 1):
            more = n[short] > j
            extra[more] = mix64(extra[more] + w[begin[short[more]] + j] + _U(101 + j))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, extra])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def set_keys(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 63-bit key of each set; equal sets have equal keys, empty ones the key 0."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(h + _U(7)))])
    size = np.diff(begin)
    key = mix64(total[begin[1:]] - total[begin[:-1]] + size.astype(_U)) >> _U(1)
    return np.where(size > 0, np.maximum(key, _U(1)), _U(0)).astype(np.int64)


@lru_cache(None)
def bands(most: int = 1 << 40, percent: int = PERCENT) -> list[int]:
    """The first size of each band: sizes of similar sets are in one band or in two that follow each other."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // percent + 1)
    return out


def scheme(upper: int, double: bool, percent: int = PERCENT) -> tuple[int, int]:
    """(segments, how many of the first ones have one-deletion neighbourhoods) of the band whose last size is upper.

    Plain segments cost one signature each, but short ones also agree where two texts only share a passage; segments
    of double length with their neighbourhoods cost about five times as many signatures and agree far more rarely.
    Plain ones still have just so many neighbourhoods as make up for empty segments."""
    budget = (100 - percent) * 2 * upper // (100 + percent)
    if double:
        m = budget // 2 + 2
        return m, m
    m = budget + 1
    empty = m * math.exp(-upper / m)
    return m, min(m, math.ceil(empty + 3 * math.sqrt(empty) + 1))


def list_lengths(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(upper, double, sets, signatures, pairs) of each band and kind of scheme: over all sets, the signatures of the
    first segment and the pairs that share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array(bands(percent=percent), np.int64)
        for part in slices(batches, limit=4 << 20):
            h, begin = shingle_sets(part["text"])
            key, size = set_keys(h, begin), np.diff(begin)
            upper = first[np.searchsorted(first, np.maximum(size, 1), side="right")] - 1
            doc = np.repeat(np.arange(len(size)), size)
            out = []
            for double in (False, True):
                m = {u: scheme(u, double, percent)[0] for u in np.unique(upper).tolist()}
                of = np.array([m[u] for u in upper.tolist()], _U)
                segment = mix64(h ^ (upper[doc].astype(_U) * _U(0x9E3779B97F4A7C15))) % of[doc]
                mine = segment == 0
                d, x = doc[mine], mix64(h[mine] + _U(3))
                total = np.zeros(len(size), _U)
                np.add.at(total, d, x)
                who = np.flatnonzero(np.bincount(d, minlength=len(size)))
                if double:
                    d, x = np.concatenate([who, d]), np.concatenate([total[who], total[d] - x])
                else:
                    d, x = who, total[who]
                out.append(np.stack([upper[d], np.full(len(d), int(double)), x.view(np.int64), key[d]], 1))
            distinct = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in distinct.T.copy()], ["upper", "double", "signature", "v"])

    found = docs.mapInArrow(run, "upper long, double long, signature long, v long").distinct()
    n = found.groupBy("upper", "double", "signature").agg(F.count("*").alias("n"))
    return n.groupBy("upper", "double").agg(F.sum("n").alias("signatures"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))


def allocation(docs: DataFrame, percent: int = PERCENT) -> frozenset[int]:
    """The bands (their last sizes) whose segments take one-deletion neighbourhoods: those where all signatures and
    the pairs that their lists make are estimated to cost less that way. A row for each band reaches the driver."""
    cost: dict[int, dict[bool, float]] = {}
    for upper, double, signatures, pairs in list_lengths(docs, percent).collect():
        cost.setdefault(upper, {})[bool(double)] = scheme(upper, bool(double), percent)[0] * (signatures + PAIR_COST * pairs)
    return frozenset(u for u, c in cost.items() if c.get(True, math.inf) < c.get(False, math.inf))


def parity_bits(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """128 bits for each set (two 64-bit numbers): bit i tells whether an odd number of members hash to i. Two sets
    differ by at least as many members as their bits differ."""
    n = len(begin) - 1
    doc = np.repeat(np.arange(n), np.diff(begin))
    at = (mix64(h + _U(29)) & _U(127)).astype(np.int64)
    odd = np.bincount(doc * 128 + at, minlength=128 * n).reshape(n, 128) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64).reshape(n, 2)


def bit_maps(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(bytes of each, all joined): as parity_bits, with two to four bits a member, a power of two of them. A map
    folds to half its size by adding its halves."""
    size = np.diff(begin)
    bits = 1 << np.maximum(np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), 7)
    at = (mix64(h + _U(31)) & (bits[np.repeat(np.arange(len(size)), size)] - 1).astype(_U)).astype(np.int64)
    first = np.cumsum(bits) - bits
    odd = np.bincount(np.repeat(first, size) + at, minlength=int(bits.sum())) & 1
    return bits // 8, np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def map_distance(n: int, a: bytes, m: int, b: bytes) -> float | None:
    """About how many members two sets of n and m members differ in, as a share of n + m, by their bit maps; None if
    too many for a link, which is never wrong about a pair that links."""
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    differ = int(np.bitwise_count(x ^ y).sum())
    return differ / (n + m) if differ * (100 + PERCENT) <= (100 - PERCENT) * (n + m) else None


def signatures(h: np.ndarray, begin: np.ndarray, doubled: frozenset[int], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, 64-bit signature): two sets with a Jaccard similarity of percent/100 share a signature.
    doubled: the bands with neighbourhoods, the same for all sets."""
    size = np.diff(begin)
    first = np.array(bands(percent=percent), np.int64)
    band = np.searchsorted(first, size, side="right") - 1
    docs, sigs = [], []
    for up in (0, 1):
        b = np.maximum(band, 0) + up
        upper = first[b + 1] - 1
        partner = np.minimum(upper, size * 100 // percent)  # of the larger set, at most
        budget = (100 - percent) * (size + partner) // (100 + percent)
        used = (size > 0) & (partner >= first[b]) & (budget > 0)
        per_band = {x: scheme(int(x), int(x) in doubled, percent) for x in np.unique(upper[used])}
        if not per_band:
            continue
        m = np.array([per_band[x][0] if k else 1 for x, k in zip(upper.tolist(), used)], np.int64)
        deep = np.array([per_band[x][1] if k else 0 for x, k in zip(upper.tolist(), used)], np.int64)
        doc = np.repeat(np.arange(len(size)), np.where(used, size, 0))
        x = h[np.repeat(used, size)]
        segment = (mix64(x ^ (upper[doc].astype(_U) * _U(0x9E3779B97F4A7C15))) % m[doc].astype(_U)).astype(np.int64)
        base = np.cumsum(np.where(used, m, 0)) - np.where(used, m, 0)
        cell = base[doc] + segment  # all segments of all sets in a row
        order = np.argsort(cell, kind="stable")
        cell, x = cell[order], mix64(x[order] + _U(3))
        cells = int(np.where(used, m, 0).sum())
        count = np.bincount(cell, minlength=cells)
        end = np.cumsum(count)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(x)])
        content = total[end] - total[end - count]
        owner = np.repeat(np.arange(len(size)), np.where(used, m, 0))
        index = np.arange(cells) - base[owner]
        double = (index < deep[owner]) & (count >= 2)
        worth = np.where(count > 0, 1 + double, 0)
        # how far down its segments a set must go for its worth to exceed the budget
        so_far = np.cumsum(worth)
        before = np.concatenate([[0], so_far])[base[owner]]
        running = so_far - before
        enough = running - worth <= budget[owner]
        reached = np.zeros(len(size), np.int64)
        np.maximum.at(reached, owner, running)
        poor = used & (reached <= budget)  # empty segments count as well for these
        plain = enough & (count > 0)
        salt = mix64(upper[owner].astype(_U) * _U(1 << 20) + index.astype(_U))
        docs.append(owner[plain])
        sigs.append(mix64(content[plain] + salt[plain]))
        hollow = ((count == 0) | ((count == 1) & (index < deep[owner]))) & poor[owner]
        docs.append(owner[hollow])
        sigs.append(mix64(salt[hollow] + _U(11)))
        near = np.flatnonzero((plain & double)[cell]) if len(cell) else np.zeros(0, np.int64)
        docs.append(owner[cell[near]])
        sigs.append(mix64(content[cell[near]] - x[near] + salt[cell[near]]))
    return (np.concatenate(docs), np.concatenate(sigs)) if docs else (np.zeros(0, np.int64), np.zeros(0, _U))


_MEMBER = np.dtype([("key", "<i8"), ("size", "<u4"), ("count", "<u4"), ("bits", "<u8", 2)])


def _sets_and_postings(docs: DataFrame, doubled: frozenset[int], buckets: int) -> DataFrame:
    """One pass over the texts: the sets (doc_ids, t, n, v) of each slice, and packed postings by bucket (members: key,
    size, parity bits and number of signatures; signatures). A task sends the postings of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names = ["bucket", "doc_ids", "t", "n", "v", "members", "sigs", "maps"]
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        for part in slices(batches, limit=4 << 20):
            h, begin = shingle_sets(part["text"])
            key, size = set_keys(h, begin), np.diff(begin)
            rows: list[tuple] = [(int(key[0] % buckets), part["doc_id"].to_pylist(), part["t"].to_pylist(), size, key, None, None, None)]
            fresh = np.zeros(len(key), bool)
            for i, k in enumerate(key.tolist()):
                if k and k not in seen:
                    seen.add(k)
                    fresh[i] = True
            own_h, own_begin = h[np.repeat(fresh, size)], np.concatenate([[0], np.cumsum(size[fresh])])
            doc, sig = signatures(own_h, own_begin, doubled)
            member = np.zeros(int(fresh.sum()), _MEMBER)
            member["key"], member["size"], member["bits"] = key[fresh], size[fresh], parity_bits(own_h, own_begin)
            bucket = (sig % _U(buckets)).astype(np.int64)
            order = np.lexsort((doc, bucket))
            doc, sig, bucket = doc[order], (sig[order] >> _U(32)).astype(np.uint32), bucket[order]
            for a, b in _cuts(bucket):
                who, n = np.unique(doc[a:b], return_counts=True)
                sent = member[who]
                sent["count"] = n
                rows.append((int(bucket[a]), None, None, None, None, sent.tobytes(), sig[a:b].tobytes(), None))
            # the bit maps go where their keys' pairs go
            length, joined = bit_maps(own_h, own_begin)
            first = np.cumsum(length) - length
            home = _home(member["key"], buckets)
            order = np.argsort(home, kind="stable")
            for a, b in _cuts(home[order]):
                i = order[a:b]
                blob = b"".join(joined[f : f + n] for f, n in zip(first[i].tolist(), length[i].tolist()))
                rows.append((int(home[i[0]]), None, None, None, None, member[i].tobytes(), None, blob))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.mapInArrow(run, "bucket int, doc_ids array<long>, t array<long>, n array<long>, v array<long>, members binary, sigs binary, maps binary")


def _home(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(key.astype(_U)) % _U(buckets)).astype(np.int64)


def _cuts(value: np.ndarray) -> list[tuple[int, int]]:
    c = np.concatenate([[0], np.flatnonzero(np.diff(value)) + 1, [len(value)]]).tolist()
    return [(a, b) for a, b in zip(c, c[1:]) if b > a]


def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two members' sizes and parity bits leave room for a link; never wrong about a pair that links."""
    n = a["size"].astype(np.int64) + b["size"]
    least = np.minimum(a["size"], b["size"]).astype(np.int64)
    differ = np.bitwise_count(a["bits"] ^ b["bits"]).astype(np.int64).sum(-1)
    return (100 * least >= PERCENT * (n - least)) & (differ * (100 + PERCENT) <= (100 - PERCENT) * n)


def candidates(group: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray | None]:
    """Of members that share a signature: the pairs to verify, and the star, if there are over PAIRED members.

    Few members are paired with each other. Of many the least is paired with all that may link to it, and the others
    are left to the star."""
    pairs = []
    for i in range(len(group) - 1 if len(group) <= PAIRED else 1):
        near = group["key"][i + 1 :][may_link(group[i], group[i + 1 :])]
        if len(near):
            pairs.append((near, np.full(len(near), group["key"][i])))
    return pairs, group["key"] if len(group) > PAIRED else None


def _meet(postings: DataFrame, buckets: int) -> DataFrame:
    """Where sets share a signature: packed pairs (to, pairs) that may link, and stars (gid, members). The sets pass
    through."""

    def run(rows: pa.Table) -> pa.Table:
        members = [np.frombuffer(x, _MEMBER) for x, m in zip(rows["members"].to_pylist(), rows["maps"].to_pylist()) if x is not None and m is None]
        member = np.concatenate(members or [np.zeros(0, _MEMBER)])
        index = np.repeat(np.arange(len(member)), member["count"])
        sig = np.frombuffer(b"".join(x for x in rows["sigs"].to_pylist() if x is not None), np.uint32)
        key = member["key"][index]
        order = np.lexsort((key, sig))
        index, key, sig = index[order], key[order], sig[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        index, sig = index[new], sig[new]
        start = np.concatenate([[0], np.flatnonzero(np.diff(sig)) + 1]) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(sig)))
        two = start[size == 2]
        a, b = member[index[two + 1]], member[index[two]]
        ok = may_link(a, b)
        pairs, out, done = [(a["key"][ok], b["key"][ok])], [], set()
        for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            group = member[index[at : at + n]]
            gid = _group_id(group["key"])
            if gid not in done:
                done.add(gid)
                more, star = candidates(group)
                pairs += more
                if star is not None:
                    out.append((None, None, gid, star) + (None,) * 6)
        pair = np.unique(np.stack([np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])], 1), axis=0)
        out += [(to, raw) + (None,) * 8 for to, raw in zip(*(_packed(pair, buckets)[c].to_pylist() for c in ("to", "pairs")))]
        out += [(b,) + (None,) * 7 + (x, m) for b, x, m in zip(*(rows[c].to_pylist() for c in ("bucket", "members", "maps"))) if m is not None]
        out += [(None,) * 4 + x + (None, None) for x in zip(*(rows[c].to_pylist() for c in ("doc_ids", "t", "n", "v"))) if x[0] is not None]
        longs = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.binary(), pa.int64(), longs, longs, longs, longs, longs, pa.binary(), pa.binary()]
        c = list(zip(*out)) or [()] * 10
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], ["to", "pairs", "gid", "members", "doc_ids", "t", "n", "v", "keys", "maps"])

    return postings.groupBy("bucket").applyInArrow(run, "to int, pairs binary, gid long, members array<long>, doc_ids array<long>, t array<long>, n array<long>, v array<long>, keys binary, maps binary")


def _group_id(keys: np.ndarray) -> int:
    return int(mix64(np.array([mix64(keys.astype(_U)).sum()], _U))[0] >> _U(1))


def _maps_of(keys: list[bytes | None], maps: list[bytes | None]) -> dict[int, tuple[int, bytes]]:
    """key -> (size, map) of packed rows."""
    out = {}
    for raw, blob in zip(keys, maps):
        at = 0
        for m in np.frombuffer(raw or b"", _MEMBER)[["key", "size"]].tolist():
            length = 1 << max(math.ceil(math.log2(max(2 * m[1], 1))), 7) - 3
            out[m[0]] = (m[1], blob[at : at + length])
            at += length
    return out


def _roots_of(rows: pa.Table) -> dict[int, int]:
    """key -> root of its component; a key that is not there is its own."""
    return dict(_read_some(rows, "roots").reshape(-1, 2).tolist())


def _read_some(rows: pa.Table, column: str, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in rows[column].to_pylist() if x is not None), kind)


def _facts(maps: DataFrame | None, comps: DataFrame | None, buckets: int) -> DataFrame:
    """What is known of keys, at their homes (to): maps (keys, maps), roots of components or both."""
    parts = []
    if maps is not None:
        parts.append(maps.select("to", "keys", "maps", F.lit(None).cast("binary").alias("roots")))
    if comps is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pair = np.stack([batch["v"].to_numpy(), batch["root"].to_numpy()], 1)
                home = _home(pair[:, 0], buckets)
                order = np.argsort(home, kind="stable")
                cuts = _cuts(home[order])
                roots = [pair[order[x:y]].tobytes() for x, y in cuts]
                none = pa.nulls(len(cuts), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([int(home[order[x]]) for x, _ in cuts], pa.int32()), none, none, pa.array(roots, pa.binary())], ["to", "keys", "maps", "roots"])

        parts.append(comps.select("v", "root").mapInArrow(run, "to int, keys binary, maps binary, roots binary"))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("d", "<f8")])


def crossing(packed: DataFrame, maps: DataFrame | None, comps: DataFrame | None, buckets: int) -> DataFrame:
    """Of packed pairs (to, pairs) the distinct ones between different components of comps, and if maps are given those
    that may link by their bit maps, which also say how far apart the two are about. Packed as (to, groups, pairs):
    a group is the greater key as long as there are no components, else the two components.

    A pair goes to the home of one key, takes what is known of it to the home of the other, and meets that one there."""
    screen, placed = maps is not None, comps is not None

    def first(rows: pa.Table, known: pa.Table) -> pa.Table:
        pair = np.unique(_read_some(rows, "pairs", _PAIR))
        map_of, root_of = _maps_of(known["keys"].to_pylist(), known["maps"].to_pylist()), _roots_of(known)
        home = _home(pair["b"], buckets)
        order = np.lexsort((pair["a"], home))
        pair, home = pair[order], home[order]
        out = []
        for x, y in _cuts(home):
            mine = np.unique(pair["a"][x:y])
            own = [map_of[k] for k in mine.tolist()] if screen else []
            member = np.zeros(len(mine), _MEMBER)
            member["key"] = mine
            if screen:
                member["size"] = [s for s, _ in own]
            roots = np.array([root_of.get(k, k) for k in mine.tolist()], np.int64)
            out.append((int(home[x]), pair[x:y].tobytes(), member.tobytes(), roots.tobytes(), b"".join(m for _, m in own)))
        c = list(zip(*out)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(z, pa.binary()) for z in c[1:])], ["to", "pairs", "keys", "own", "maps"])

    def second(rows: pa.Table, known: pa.Table) -> pa.Table:
        map_of, root_of = _maps_of(known["keys"].to_pylist(), known["maps"].to_pylist()), _roots_of(known)
        found = [np.zeros(0, np.dtype([("g", "<i8"), *_PAIR.descr]))]
        for raw, keys, own, blob in zip(*(rows[c].to_pylist() for c in ("pairs", "keys", "own", "maps"))):
            theirs = _maps_of([keys], [blob]) if screen else {}
            roots = dict(zip(np.frombuffer(keys, _MEMBER)["key"].tolist(), np.frombuffer(own, np.int64).tolist()))
            got = []
            for a, b, d in np.frombuffer(raw, _PAIR).tolist():
                ra, rb = roots[a], root_of.get(b, b)
                if ra == rb:
                    continue
                if screen:
                    d = map_distance(*theirs[a], *map_of[b])
                    if d is None:
                        continue
                got.append((ra, rb, a, b, d))
            if got:
                ra, rb, a, b, d = (np.array(x) for x in zip(*got))
                part = np.zeros(len(a), found[0].dtype)
                part["a"], part["b"], part["d"] = a, b, d
                part["g"] = (mix64(mix64(np.minimum(ra, rb).astype(_U)) + np.maximum(ra, rb).astype(_U)) >> _U(1)).astype(np.int64) if placed else a
                found.append(part)
        pair = np.concatenate(found)
        home = _home(pair["g"], buckets)
        order = np.argsort(home, kind="stable")
        pair, home = pair[order], home[order]
        out = [(int(home[x]), pair["g"][x:y].tobytes(), _plain(pair[x:y]).tobytes()) for x, y in _cuts(home)]
        c = list(zip(*out)) or [()] * 3
        return pa.Table.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(z, pa.binary()) for z in c[1:])], ["to", "groups", "pairs"])

    facts = _facts(maps, comps, buckets)
    half = packed.groupBy("to").cogroup(facts.groupBy("to")).applyInArrow(first, "to int, pairs binary, keys binary, own binary, maps binary")
    return half.groupBy("to").cogroup(facts.groupBy("to")).applyInArrow(second, "to int, groups binary, pairs binary")


def _plain(pair: np.ndarray) -> np.ndarray:
    out = np.zeros(len(pair), _PAIR)
    for c in "abd":
        out[c] = pair[c]
    return out


def closest(pairs: DataFrame, k: int, buckets: int) -> DataFrame:
    """Of packed (to, groups, pairs) the k closest pairs of each group as rows (v, p), the others packed (to, pairs)."""

    def run(rows: pa.Table) -> pa.Table:
        group, pair = _read_some(rows, "groups"), _read_some(rows, "pairs", _PAIR)
        order = np.lexsort((pair["b"], pair["a"], pair["d"], group))
        group, pair = group[order], pair[order]
        start = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1]) if len(group) else np.zeros(0, np.int64)
        best = spread(np.diff(np.append(start, len(group)))) < k
        v, p, rest = pair["a"][best], pair["b"][best], pair[~best]
        home = _home(rest["a"], buckets)
        order = np.argsort(home, kind="stable")
        rest, home = rest[order], home[order]
        cuts = _cuts(home)
        none = [None] * len(cuts)
        columns = [[*v.tolist(), *none], [*p.tolist(), *none], [None] * len(v) + [int(home[x]) for x, _ in cuts], [None] * len(v) + [rest[x:y].tobytes() for x, y in cuts]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["v", "p", "to", "pairs"])

    return pairs.groupBy("to").applyInArrow(run, "v long, p long, to int, pairs binary")


def _keys_of(step: DataFrame) -> DataFrame:
    """The distinct keys v of what closest() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = np.frombuffer(b"".join(x for x in batch["pairs"].to_pylist() if x is not None), _PAIR)
            some = [batch[c].drop_null().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("v", "p")]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([pair["a"], pair["b"], *some])), pa.int64())], ["v"])

    return step.mapInArrow(run, "v long").distinct()


#: A member of a tile: which tile, which of its two sides, component, key.
_PLACE = np.dtype([("tile", "<i8"), ("side", "u1"), ("root", "<i8"), ("key", "<i8")])


def _by_home(x: np.ndarray, by: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """x cut by the homes of by."""
    home = _home(by, buckets)
    order = np.argsort(home, kind="stable")
    return [(int(home[order[a]]), order[a:b]) for a, b in _cuts(home[order])] if len(x) else []


def _bytes_table(rows: list[tuple], *names: str) -> pa.Table:
    c = list(zip(*rows)) or [()] * (1 + len(names))
    return pa.Table.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(x, pa.binary()) for x in c[1:])], ["to", *names])


def tiles(star: np.ndarray, width: int = TILE) -> list[np.ndarray]:
    """The members (_PLACE, tile: the star's id) of a star dealt to tiles, so that any two of different components meet
    in one; of a star of one component none."""
    star = star[np.lexsort((star["key"], star["root"]))]
    if star["root"][0] == star["root"][-1]:
        return []
    blocks = [star[i : i + width] for i in range(0, len(star), width)]
    out = []
    for i, x in enumerate(blocks):
        for j, y in enumerate(blocks[i:], i):
            if x["root"][0] == y["root"][-1]:  # all of one component
                continue
            both = np.concatenate([x, y] if j > i else [x])
            both["side"][len(x) :] = 1
            both["tile"] = int(mix64(np.array([mix64(np.array([star["tile"][0]], np.int64).astype(_U))[0] + _U(i * len(blocks) + j)], _U))[0] >> _U(1))
            out.append(both)
    return out


def may_link_by_maps(size: np.ndarray, maps: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Which of the others may link to one, by sizes and bit maps of one width; never wrong about a pair that links."""
    n, least = size[others] + size[one], np.minimum(size[others], size[one])
    differ = np.bitwise_count(maps[others] ^ maps[one]).astype(np.int64).sum(1)
    return (100 * least >= PERCENT * (n - least)) & (differ * (100 + PERCENT) <= (100 - PERCENT) * n)


def strays(stars: DataFrame, maps: DataFrame, comps: DataFrame, buckets: int) -> DataFrame:
    """Packed pairs (to, pairs) of members of a star (gid, members) that are in different components and may link by
    their bit maps. A member learns its component at its home; where a star has several, its members fetch their maps
    and meet in tiles of bounded size."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros(len(batch["members"].flatten()), _PLACE)
            x["key"] = batch["members"].flatten().to_numpy(zero_copy_only=False)
            x["tile"] = np.repeat(batch["gid"].to_numpy(), batch["members"].value_lengths().to_numpy())
            yield from _bytes_table([(to, x[i].tobytes()) for to, i in _by_home(x, x["key"], buckets)], "places").to_batches()

    def place(rows: pa.Table, known: pa.Table) -> pa.Table:
        x = np.unique(_read_some(rows, "places", _PLACE))
        root_of = _roots_of(known)
        x["root"] = [root_of.get(k, k) for k in x["key"].tolist()]
        return _bytes_table([(to, x[i].tobytes()) for to, i in _by_home(x, x["tile"], buckets)], "places")

    def part(rows: pa.Table) -> pa.Table:
        x = _read_some(rows, "places", _PLACE)
        x = x[np.argsort(x["tile"], kind="stable")]
        found = [np.zeros(0, _PLACE)]
        for a, b in _cuts(x["tile"]):
            found += tiles(x[a:b])
        x = np.concatenate(found)
        return _bytes_table([(to, x[i].tobytes()) for to, i in _by_home(x, x["key"], buckets)], "places")

    def fetch(rows: pa.Table, known: pa.Table) -> pa.Table:
        x = _read_some(rows, "places", _PLACE)
        map_of = _maps_of(known["keys"].to_pylist(), known["maps"].to_pylist())
        out = []
        for to, i in _by_home(x, x["tile"], buckets):
            sizes, folded = [], []
            for k in x["key"][i].tolist():
                n, m = map_of[k]
                y = np.frombuffer(m, _U)
                while len(y) > MAP_BITS // 64:
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                sizes.append((n, len(y)))
                folded.append(y.tobytes())
            out.append((to, x[i].tobytes(), np.array(sizes, np.int64).tobytes(), b"".join(folded)))
        return _bytes_table(out, "places", "sizes", "maps")

    def meet(rows: pa.Table) -> pa.Table:
        x, sizes, flat = _read_some(rows, "places", _PLACE), _read_some(rows, "sizes").reshape(-1, 2), _read_some(rows, "maps", _U)
        begin = np.cumsum(sizes[:, 1]) - sizes[:, 1]
        order = np.lexsort((x["key"], x["side"], x["tile"]))
        pairs = [np.zeros((0, 2), np.int64)]
        for a, b in _cuts(x["tile"][order]):
            i = order[a:b]
            tile, size, width = x[i], sizes[i, 0], sizes[i, 1]
            least = int(width.min())
            folded = np.zeros((len(i), least), _U)
            for k, (at, w) in enumerate(zip(begin[i].tolist(), width.tolist())):
                folded[k] = np.bitwise_xor.reduce(flat[at : at + w].reshape(-1, least))
            half = int(np.searchsorted(tile["side"], 1))
            for k in range(half):
                others = np.arange(half, len(i)) if half < len(i) else np.arange(k + 1, len(i))
                others = others[tile["root"][others] != tile["root"][k]]
                near = tile["key"][others[may_link_by_maps(size, folded, k, others)]]
                if len(near):
                    pairs.append(np.stack([np.maximum(near, tile["key"][k]), np.minimum(near, tile["key"][k])], 1))
        return _packed(np.unique(np.concatenate(pairs), axis=0), buckets)

    dealt = stars.select("gid", "members").mapInArrow(deal, "to int, places binary")
    placed = dealt.groupBy("to").cogroup(_facts(None, comps, buckets).groupBy("to")).applyInArrow(place, "to int, places binary")
    parted = placed.groupBy("to").applyInArrow(part, "to int, places binary")
    fetched = parted.groupBy("to").cogroup(maps.groupBy("to")).applyInArrow(fetch, "to int, places binary, sizes binary, maps binary")
    return fetched.groupBy("to").applyInArrow(meet, "to int, pairs binary")


def _packed(pair: np.ndarray, buckets: int) -> pa.Table:
    """Pairs of keys (two columns) as rows (to, pairs) for the homes of the first keys."""
    out = np.zeros(len(pair), _PAIR)
    out["a"], out["b"] = pair[:, 0], pair[:, 1]
    home = _home(out["a"], buckets)
    order = np.argsort(home, kind="stable")
    out, home = out[order], home[order]
    cuts = _cuts(home)
    return pa.Table.from_arrays([pa.array([int(home[x]) for x, _ in cuts], pa.int32()), pa.array([out[x:y].tobytes() for x, y in cuts], pa.binary())], ["to", "pairs"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(v, p, linked, distance) for each pair of keys (v, p), from texts (v, text), exactly.

    A key with many partners is dealt to several groups, each of which gets its text once."""
    spark = pairs.sparkSession
    counts = pairs.groupBy("p").agg(F.count("*").alias("c"))
    salted = pairs.join(counts, "p").select("v", "p", F.pmod(F.xxhash64("v"), F.ceil(F.col("c") / GROUP_PARTNERS)).cast("int").alias("salt"))
    salted = stored(salted, "salted")
    left = salted.join(texts, "v").select("p", "salt", F.lit(1).alias("turn"), "v", "text")
    right = salted.select("p", "salt").distinct().join(texts.withColumnRenamed("v", "p"), "p").select("p", "salt", F.lit(0).alias("turn"), F.col("p").alias("v"), "text")
    dealt = left.unionAll(right).repartition(partitions(spark), "p", "salt").sortWithinPartitions("p", "salt", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for part in slices(batches):
            h, begin = shingle_sets(part["text"])
            out = []
            for i, (p, turn, v) in enumerate(zip(part["p"].to_pylist(), part["turn"].to_pylist(), part["v"].to_pylist())):
                own = h[begin[i] : begin[i + 1]]
                if turn == 0:
                    pivot = own.copy()
                    continue
                both = len(np.intersect1d(pivot, own, assume_unique=True))
                union = len(pivot) + len(own) - both
                out.append((v, p, 100 * both >= PERCENT * union and union > 0, 1 - both / union if union else 1.0))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2]), pa.array(c[3], pa.float64())], ["v", "p", "linked", "distance"])

    return dealt.mapInArrow(run, "v long, p long, linked boolean, distance double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    A document's set: its distinct shingles of five words (A-Z in lower case); with fewer words all of them as one;
    without words or text none, and no links. Documents link when their sets' Jaccard similarity is at least 0.8;
    component_id is the smallest id that can be reached by links. Equal sets are one vertex; rows with equal ids are
    rows of their own; a null id is never the smallest of several. Other columns are not looked at.

    Of a few sets that share a signature all pairs that may link are verified; of many the least is paired with the
    others, and they are a star. Each set is first verified against the closest of its partners; then only pairs
    between different components are left to verify, ever more for each two of them until none is left. Where members
    of a star are in different components, their bit maps are compared, and pairs made only of those that may link. So
    no link between components is lost, and a family of copies costs about as many verifications as it has members.
    """
    sets, groups = _classes(docs, id_col, text_col)
    least = groups.groupBy("root").agg(F.min("rep").alias("component"))
    named = stored(groups.join(least, "root").select("v", "component"), "named")
    return sets.join(named, "v", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, n, v) of every row: a hash of its text, the size and the key of its set (0: none); and (v, rep,
    root) of every set: its least doc_id, and the key that stands for its component."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = base.withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    buckets = bucket_count(base)
    hits = stored(_meet(_sets_and_postings(hashed, allocation(base), buckets), buckets), "hits")
    zipped = F.explode(F.arrays_zip("doc_ids", "t", "n", "v")).alias("x")
    sets = stored(hits.filter("doc_ids is not null").select(zipped).select("x.doc_ids", "x.t", "x.n", "x.v").toDF("doc_id", "t", "n", "v"), "sets")
    classes = stored(sets.filter("v <> 0").groupBy("v").agg(F.min("doc_id").alias("rep")), "classes")
    maps = hits.filter("maps is not null").select("to", "keys", "maps")
    comps = spark.createDataFrame([], "v long, root long")
    comps = _joined(hits.filter("pairs is not null").select("to", "pairs"), maps, comps, base, classes, buckets, fresh=True)
    left = stored(strays(hits.filter("gid is not null"), maps, comps, buckets), "strays")
    comps = _joined(left, maps, comps, base, classes, buckets)
    groups = stored(classes.join(comps, "v", "left").select("v", "rep", F.coalesce("root", "v").alias("root")), "groups")
    discard(hits, left, classes)
    return sets, groups


def _joined(packed: DataFrame, maps: DataFrame, comps: DataFrame, base: DataFrame, classes: DataFrame, buckets: int, fresh: bool = False) -> DataFrame:
    """comps (v, root) with the links of packed pairs (to, pairs) added: rounds of the closest pairs between different
    components, sixteen times as many for each two of them in each round, until no pair is left."""
    k = 1
    step = stored(closest(crossing(packed, maps, None if fresh else comps, buckets), k, buckets), "chosen")
    if step.isEmpty():
        return comps
    texts = stored(_texts_of(base, _keys_of(step).join(classes, "v").select("v", F.col("rep").alias("doc_id"))), "texts")
    while not step.isEmpty():
        links = stored(verify(step.filter("v is not null").select("v", "p"), texts), "verified")
        edges = comps.select(F.col("v").alias("a"), F.col("root").alias("b")).unionAll(links.filter("linked").select("v", "p"))
        comps = stored(components(edges), "components")
        discard(links)
        rest, k, last = step.filter("pairs is not null").select("to", "pairs"), 16 * k, step
        if rest.isEmpty():
            break
        step = stored(closest(crossing(rest, None, comps, buckets), k, buckets), "chosen")
        discard(last)
    discard(step, texts)
    return comps


def _texts_of(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, text) of the wanted (v, doc_id); of rows with equal ids the one whose set has the key. Keys without an id
    find their texts among the rows without one, by the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, begin = shingle_sets(part["text"])
            yield part.filter(pa.array(set_keys(h, begin) == part["v"].to_numpy()))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(*shingle_sets(part["text"]))), part["text"]], ["v", "text"])

    named = base.join(wanted, "doc_id").select("v", "text").mapInArrow(run, "v long, text string")
    nameless = base.filter("doc_id is null").select("text").mapInArrow(keyed, "v long, text string")
    return named.unionAll(nameless.join(wanted.filter("doc_id is null").select("v"), "v").groupBy("v").agg(F.min("text").alias("text")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs of each component, with the columns of docs: of its rows the one with the least doc_id, of
    those with equal ids the one with the least hash of its text; a null id comes last. Of rows with equal id and text
    one stays, whichever. Rows without words stay all."""
    sets, groups = _classes(docs, "doc_id", "text")
    of = sets.filter("v <> 0").join(groups.select("v", "root"), "v").select("root", F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), "t", F.struct(F.col("doc_id").isNull(), "doc_id", "t").alias("place"))
    first = stored(of.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("c")).filter("c > 1"), "first")
    rows = of.join(first, "root")
    dropped = stored(rows.filter("place <> first").select("_id", "t").distinct(), "dropped")
    twins = stored(rows.filter("place = first").groupBy("_id", "t").agg(F.count("*").alias("c")).filter("c > 1").select("_id", "t"), "twins")
    names = [f"`{c}`" for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    kept = keyed.join(dropped, ["_id", "t"], "left_anti")
    single = kept.join(twins, ["_id", "t"], "left_anti")
    double = kept.join(twins, ["_id", "t"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("_id", "t").orderBy("_id"))).filter("n = 1")
    return single.select("row.*").unionAll(double.select("row.*"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
