"""Language-model scoring by Katz backoff over words, of any order.

Texts are coded in blocks. Each block asks the hash-partitioned count tables for the n-grams it holds, each once; the
tables add up the training counts and answer. With the answers a block knows the Good-Turing discounted probabilities of
the n-grams that training has seen. An n-gram of three and more words is only asked for where other blocks have both its
history and its suffix; else no other block can have it, and the block's own count is the count. An n-gram that it has not seen has the backoff weight of its history times the
probability of the next lower order, and so on down to single words. The weights come from the histories' partitions:
each distinct trained n-gram adds, once, what its history has lost by discounting and what the lower order gives to its
word, so all weights are exactly normalised. A block asks for each weight once. A history that stands in one block alone
is weighed there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import bucket_count, cuts, discard, hash64, mix64, pack, release_shuffles, slices, stored, table, table_of, unpack, words

#: Words of an n-gram at most.
ORDER = 3
#: Counts above this are not discounted, but for TAIL of a count, so that every history has mass left.
LARGEST, TAIL = 5, 0.01
_U = np.uint64
_END, _START = _U(0x51ED270B27A4F3D1), _U(0x2545F4914F6CDD1D)


def held_out_column(id_column):
    """Whether a document is left out of training: crc32 of its id as text, mod 5, is 1 (a null id's is not)."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 1, F.lit(False))


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Good-Turing factors d for counts 0..LARGEST+1 (the last: all larger counts) from the numbers n of n-grams that
    occur 1..LARGEST+1 times: d = (r*/r - a) / (1 - a), r* = (r+1) n[r+1] / n[r], a = (LARGEST+1) n[LARGEST+1] / n[1].
    Where that is not between 0 and 1 (few data), half a count is taken off instead."""
    n = np.concatenate([[0.0], counts_of_counts.astype(float), [0.0]])
    out = np.ones(LARGEST + 2)
    a = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1.0
    for r in range(1, LARGEST + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and n[r + 1] and a < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The mass that is left of each count."""
    return np.where(count > LARGEST, count - TAIL, d[np.minimum(count, LARGEST)] * count)


def taken(d: np.ndarray) -> np.ndarray:
    """What is taken off counts of 1..LARGEST and of more."""
    return np.append((1 - d[1 : LARGEST + 1]) * np.arange(1, LARGEST + 1), TAIL)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(before * _U(0x9E3779B97F4A7C15) + mix64(word))


def code_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as blocks: ids, held-out marks, where each text begins, the words' codes (0: the end), their hashes."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out_column(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        known: dict[str, int] = {}
        hashes, ids, held, sizes, codes, total = [np.array([_END])], [], [], [], [], 0

        def block() -> pa.RecordBatch:
            size = np.concatenate(sizes)
            valid = pa.array([x for part in ids for x in part], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([valid], pa.list_(pa.int64())), pa.array([pack(np.concatenate(held))], pa.binary()), pa.array([pack(size.astype(np.int32))], pa.binary()), pa.array([pack(np.concatenate(codes).astype(np.int32))], pa.binary()), pa.array([np.concatenate(hashes).tobytes()], pa.binary())], ["block", "doc_ids", "held", "sizes", "codes", "words"])

        for part in slices(batches):
            code, distinct, begin = words(part["text"])
            to = np.empty(len(distinct), np.int64)
            new = []
            for i, w in enumerate(distinct):
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known) + 1
                    new.append(w)
                to[i] = k
            hashes.append(hash64(new))
            n = np.diff(begin)
            whole = np.zeros(len(code) + len(n), np.int64)
            place = np.arange(len(code)) + np.repeat(np.arange(len(n)), n)
            whole[place] = to[code] if len(code) else 0
            ids.append(part["doc_id"].to_pylist())
            held.append(part["held_out"].to_numpy(zero_copy_only=False).astype(np.uint8))
            sizes.append(n + 1)
            codes.append(whole)
            total += int(part["text"].nbytes)
            if total >= BLOCK_BYTES:
                yield block()
                number += 1
                known = {}
                hashes, ids, held, sizes, codes, total = [np.array([_END])], [], [], [], [], 0
        if ids:
            yield block()

    return base.mapInArrow(run, "block long, doc_ids array<long>, held binary, sizes binary, codes binary, words binary")


class Block:
    """The n-grams of one block. For each order the distinct ones, their histories (of the order below; of single words
    none) and suffixes (likewise), and the n-gram that ends at each word, -1 where the text has not yet so many."""

    def __init__(self, row: dict, parts: int, order: int):
        self.ids = row["doc_ids"]
        self.held = unpack(row["held"], np.uint8)[0].astype(bool)
        size = unpack(row["sizes"], np.int32)[0].astype(np.int64)
        code = unpack(row["codes"], np.int32)[0].astype(np.int64)
        word = np.frombuffer(row["words"], _U)
        self.doc = np.repeat(np.arange(len(size)), size)
        trained = ~self.held[self.doc]
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        self.of, self.keys = [code], [np.append(mix64(word), mix64(np.array([_START])))]  # the start is a history only
        self.history, self.suffix = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in range(2, order + 1):
            before = np.full(len(code), -1)
            before[1:] = self.of[-1][:-1]
            before[place == 0] = len(word) if n == 2 else -1
            at = np.flatnonzero(before >= 0)
            gram, first, which = np.unique(before[at] * len(word) + code[at], return_index=True, return_inverse=True)
            of = np.full(len(code), -1)
            of[at] = which
            self.history.append(gram // len(word))
            self.suffix.append(self.of[-1][at[first]])
            self.keys.append(pair_keys(self.keys[-1][gram // len(word)], word[gram % len(word)]))
            self.of.append(of)
        self.n = [len(word), *map(len, self.history[1:])]
        self.count, self.in_held, self.part, self.order = [], [], [], []
        for of, key, n in zip(self.of, self.keys, self.n):
            self.count.append(np.bincount(of[trained & (of >= 0)], minlength=n))
            self.in_held.append(np.bincount(of[~trained & (of >= 0)], minlength=n) > 0)
            part = (key[:n] % _U(parts)).astype(np.int64)
            self.order.append(np.lexsort((key[:n], part)))
            self.part.append(part[self.order[-1]])


def _packed(key: np.ndarray) -> bytes:
    """The 48 high bits of each key, keys in order. The partition tells log2(partitions) bits more: of a million n-grams
    in a partition any two are the same with a probability of 0.2 %."""
    return pack(np.diff(key >> _U(16), prepend=_U(0)))


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, _U)[0], dtype=_U)


_ASK = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("totals", pa.list_(pa.int64()))])
_ASK_SQL = "part int, kind int, block long, keys binary, counts binary, totals array<long>"
_TOLD = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("answer", pa.binary()), ("totals", pa.list_(pa.int64()))])
#: Marks of an n-gram in an answer: this block is the first that has it in training; no other block has it at all; a
#: held-out text has it, so its weight as a history may be wanted.
OWN, SOLE, HELD = 1, 2, 4
#: Bytes of text in a block, about.
BLOCK_BYTES = 6 << 20


def _counts_of_counts(seen: np.ndarray) -> list[int]:
    """Number, sum, and how many of them are 1..LARGEST+1."""
    return [len(seen), int(seen.sum()), *np.bincount(np.minimum(seen, LARGEST + 2), minlength=LARGEST + 3)[1 : LARGEST + 2].tolist()]


def _ask(row: dict, b: Block, kind: int, some: np.ndarray, parts: int) -> list[tuple]:
    """What a block asks about some of its n-grams of an order; the others are its own, of which it tells the totals."""
    o = b.order[kind][some[b.order[kind]]]
    key, count = b.keys[kind][o], (2 * b.count[kind][o] + b.in_held[kind][o]).astype(np.uint32)
    part = (key % _U(parts)).astype(np.int64)
    out = [(int(part[x]), kind, row["block"], _packed(key[x:y]), pack(count[x:y]), None) for x, y in cuts(part)]
    own = b.count[kind][~some]
    if len(own):
        out.append((zlib.crc32(str(row["block"]).encode()) % parts, kind, None, None, None, _counts_of_counts(own[own > 0])))
    return out


class Answers:
    """The counts and marks of a block's n-grams, as far as they have been answered."""

    def __init__(self, b: Block, rows: pa.Table, kinds: int):
        given = rows.sort_by([("kind", "ascending"), ("part", "ascending")])
        kind_of, raw = given["kind"].to_numpy(), given["answer"].to_pylist()
        self.count, self.marks = [], []
        for kind in range(kinds):
            asked = self.asked(b, kind)
            count, marks = b.count[kind].copy(), (SOLE + OWN * (b.count[kind] > 0) + HELD * b.in_held[kind]).astype(np.uint8)
            o = b.order[kind][asked[b.order[kind]]]
            if len(o):
                count[o], marks[o] = (np.concatenate(x) for x in zip(*(unpack(raw[i], np.uint32, "u1") for i in np.flatnonzero(kind_of == kind))))
            self.count.append(count)
            self.marks.append(marks)

    def asked(self, b: Block, kind: int) -> np.ndarray:
        """Which n-grams of an order other blocks may have: those of up to two words, and those whose parts others have."""
        if kind < 2:
            return np.ones(b.n[kind], bool)
        others = self.marks[kind - 1] & SOLE == 0
        return others[b.history[kind]] & others[b.suffix[kind]]


def _asks(blocks: DataFrame, told: DataFrame | None, kinds: tuple[int, ...], parts: int) -> DataFrame:
    if told is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    b = Block(row, parts, kinds[-1] + 1)
                    for kind in kinds:
                        yield from table_of(_ask(row, b, kind, np.ones(b.n[kind], bool), parts), _ASK).to_batches()

        return blocks.mapInArrow(run, _ASK_SQL)

    def with_answers(block_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        row, (kind,) = block_rows.to_pylist()[0], kinds
        b = Block(row, parts, kind + 1)
        return table_of(_ask(row, b, kind, Answers(b, answer_rows, kind).asked(b, kind), parts), _ASK)

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(with_answers, _ASK_SQL)


def _answer(asked: DataFrame) -> DataFrame:
    """For each asking block the training counts and marks of its n-grams; and for each partition and order the number,
    the sum and the counts of counts."""

    def run(rows: pa.Table) -> pa.Table:
        own = [(None, None, k, None, t) for k, t in zip(rows["kind"].to_pylist(), rows["totals"].to_pylist()) if t is not None]
        rows = rows.filter(pc.is_valid(rows["block"])).sort_by([("kind", "ascending"), ("block", "ascending")])
        if not rows.num_rows:
            return table_of(own, _TOLD)
        part, kinds, block = rows["part"][0].as_py(), rows["kind"].to_numpy(), rows["block"].to_pylist()
        keys, counts = rows["keys"].to_pylist(), rows["counts"].to_pylist()
        out = own
        for first, end in cuts(kinds):
            kind, mine = int(kinds[first]), range(first, end)
            parts = [_keys(keys[i]) for i in mine]
            key = np.concatenate(parts)
            count = np.concatenate([unpack(counts[i], np.uint32)[0] for i in mine]).astype(np.int64)
            count, held = count >> 1, count & 1
            order = np.argsort(key, kind="stable")
            new = np.ones(len(key), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
            total = np.bincount(group, count[order]).astype(np.int64)
            answer, mark = np.empty(len(key), np.uint32), np.zeros(len(key), np.uint8)
            answer[order] = total[group]
            has = np.minimum.reduceat(np.where(count[order] > 0, np.arange(len(key)), len(key)), begin)
            mark[order[has[has < len(key)]]] = OWN
            mark[order[begin[np.diff(np.append(begin, len(key))) == 1]]] |= SOLE
            mark[order] |= (np.maximum.reduceat(held[order], begin)[group] * HELD).astype(np.uint8)
            at = 0
            for i, n in zip(mine, map(len, parts)):
                out.append((block[i], part, kind, pack(answer[at : at + n], mark[at : at + n]), None))
                at += n
            seen = total[total > 0]
            out.append((None, part, kind, None, _counts_of_counts(seen)))
        return table_of(out, _TOLD)

    return asked.groupBy("part").applyInArrow(run, "block long, part int, kind int, answer binary, totals array<long>")


#: What a block sends: contributions to weights (lost, lower) and wishes for weights, both by the keys of histories; and,
#: without a partition, what it keeps: its rows and what they lack, (document, number of the wish).
#: A contribution: order, count of the history, what the lower order gives, followers by counts of 1..LARGEST and more.
_LOST_KINDS = ("u1", np.int64, float, *[np.uint32] * (LARGEST + 1))
_SENT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("at", pa.int32()), ("keys", pa.binary()), ("lost", pa.binary()), ("rows", pa.binary()), ("lacks", pa.binary())])
_WEIGHT = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("weights", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Tokens: words (A-Z in lower case), then one end; a null text has the end alone. Documents that are not held out
    train the model: n-grams of up to order words with Good-Turing discounts that back off to one word less; all words
    that training lacks share what the single words leave. A text's first word follows its start. score: log10
    probability of the text; base_score: that of single words with half a count added. Rows with equal ids are rows of
    their own; without training rows every token is unknown; no rows give none. Other columns are not looked at.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    parts = 2 * bucket_count(docs, text_col)
    blocks = stored(code_blocks(docs, id_col, text_col), "blocks")
    written = [blocks, stored(_answer(_asks(blocks, None, tuple(range(min(order, 2))), parts)), "counts")]
    answers = written[-1]
    release_shuffles(docs.sparkSession)
    for kind in range(2, order):
        told = answers.filter("block is not null").drop("totals")
        written.append(stored(_answer(_asks(blocks, told, (kind,), parts)), "counts"))
        answers = answers.unionAll(written[-1])
        release_shuffles(docs.sparkSession)
    totals = np.zeros((order, LARGEST + 3), np.int64)
    for r in answers.filter("totals is not null").groupBy("kind").agg(*[F.sum(F.col("totals")[i]).alias(f"t{i}") for i in range(LARGEST + 3)]).collect():
        totals[r["kind"]] = np.array(r[1:], np.int64)
    n_words, n_tokens = int(totals[0][0]), int(totals[0][1])
    d = [discounts(t[2:]) for t in totals]
    base_log = lambda c: np.log10((c + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
    known = totals[0][2 : LARGEST + 2]
    lost_words = float(((1 - d[0][1 : LARGEST + 1]) * np.arange(1, LARGEST + 1) * known).sum() + TAIL * (n_words - known.sum()))
    unknown = lost_words / n_tokens if n_tokens else 1.0
    starts = docs.filter(~held_out_column(F.col(id_col))).count()

    def weigh(block_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        row = block_rows.to_pylist()[0]
        b = Block(row, parts, order)
        given = Answers(b, answer_rows, order)
        count, marks = given.count, given.marks
        with_start = [np.append(count[0], starts), *count[1:]]
        alone = [np.append(marks[0] & SOLE > 0, False), *(m & SOLE > 0 for m in marks[1:])]
        wanted = [np.append(marks[0] & HELD > 0, True), *(m & HELD > 0 for m in marks[1:])]
        p = [np.where(count[0] > 0, discounted(count[0], d[0]) / max(n_tokens, 1), unknown)]
        out, wishes, found = [], [], []
        for k in range(1, order):
            c, h = count[k], b.history[k]
            of_history = np.maximum(with_start[k - 1][h], 1)
            p.append(discounted(c, d[k]) / of_history)
            own = marks[k] & OWN > 0
            n = len(with_start[k - 1])
            followers = np.bincount(h[own] * (LARGEST + 1) + np.minimum(c[own], LARGEST + 1) - 1, minlength=n * (LARGEST + 1)).reshape(n, LARGEST + 1)
            lost = followers @ taken(d[k]) / np.maximum(with_start[k - 1], 1)
            lower = np.bincount(h[own], p[k - 1][b.suffix[k]][own], n)
            adds = np.bincount(h[own], minlength=n) > 0
            asks = np.zeros(n, bool)
            asks[h[(c == 0) & (with_start[k - 1][h] > 0)]] = True
            weight = np.zeros(n)
            mine = adds & alone[k - 1]
            weight[mine] = np.log10(np.maximum(lost[mine], 1e-300)) - np.log10(np.maximum(1 - lower[mine], 1e-12))
            found.append(weight)
            asks &= ~mine
            adds &= ~mine & wanted[k - 1]
            key = mix64(b.keys[k - 1] + _U(k))  # orders apart
            for some, adding in ((np.flatnonzero(adds), True), (np.flatnonzero(asks), False)):
                part = (key[some] % _U(parts)).astype(np.int64)
                o = np.lexsort((key[some], part))
                some, part = some[o], part[o]
                begin = sum(map(len, wishes))
                for x, y in cuts(part):
                    i = some[x:y]
                    lost_there = pack(np.full(len(i), k, np.uint8), with_start[k - 1][i].astype(np.int64), lower[i], *followers[i].T.astype(np.uint32)) if adding else None
                    out.append((int(part[x]), row["block"], None if adding else begin + x, _packed(key[i]), lost_there, None, None))
                if not adding:
                    wishes.append(some)
        # down the orders: what training has not seen backs off
        value, open_ = np.zeros(len(b.doc)), np.ones(len(b.doc), bool)
        lacks = []
        for k in range(order - 1, 0, -1):
            at = np.flatnonzero(open_ & (b.of[k] >= 0))
            gram = b.of[k][at]
            seen = count[k][gram] > 0
            value[at[seen]] += np.log10(p[k][gram[seen]])
            open_[at[seen]] = False
            at, h = at[~seen], b.history[k][gram[~seen]]
            value[at] += found[k - 1][h]
            number = np.full(len(with_start[k - 1]), -1)
            number[wishes[k - 1]] = np.arange(len(wishes[k - 1])) + sum(map(len, wishes[: k - 1]))
            wants = number[h] >= 0
            lacks.append((b.doc[at[wants]], number[h[wants]]))
        value[open_] += np.log10(p[0][b.of[0][open_]])
        n = len(b.ids)
        rows = pack(np.bincount(b.doc, minlength=n), np.bincount(b.doc, count[0][b.of[0]] > 0, n).astype(np.int64), np.bincount(b.doc, base_log(count[0])[b.of[0]], n), np.bincount(b.doc, value, n), b.held.astype(np.uint8), np.array([i is not None for i in b.ids], np.uint8), np.array([i or 0 for i in b.ids], np.int64))
        doc, wish = (np.concatenate(x) for x in zip(*lacks)) if lacks else (np.zeros(0), np.zeros(0))
        out.append((None, row["block"], None, None, None, rows, pack(doc.astype(np.uint32), wish.astype(np.uint32))))
        return table_of(out, _SENT)

    weighing = blocks.groupBy("block").cogroup(answers.filter("block is not null").drop("totals").groupBy("block")).applyInArrow(weigh, "part int, block long, at int, keys binary, lost binary, rows binary, lacks binary")
    sent = stored(weighing, "sent")
    del weighing, answers
    discard(*written)  # all that follows reads what has been sent alone
    release_shuffles(docs.sparkSession)

    def back_off(rows: pa.Table) -> pa.Table:
        block, at, keys, lost = (rows[c].to_pylist() for c in ("block", "at", "keys", "lost"))
        made = [i for i, x in enumerate(lost) if x is not None]
        key = np.concatenate([_keys(keys[i]) for i in made] or [np.zeros(0, _U)])
        k, total, lower, *followers = (np.concatenate(x) for x in zip(*(unpack(lost[i], *_LOST_KINDS) for i in made))) if made else (np.zeros(0, np.int64),) * (LARGEST + 4)
        order_ = np.lexsort((lower, key))  # sums don't depend on who comes first
        key = key[order_]
        start = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1]) if len(key) else np.zeros(0, np.int64)
        add = lambda x: np.add.reduceat(x[order_], start) if len(key) else np.zeros(0)
        of_order = k[order_][start].astype(np.int64)
        left = sum(np.array([taken(x)[r] for x in d])[of_order] * add(f.astype(np.int64)) for r, f in enumerate(followers)) / np.maximum(total[order_][start], 1)
        weight = np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(1 - add(lower), 1e-12))
        key = key[start]
        return table_of([(block[i], at[i], pack(weight[np.searchsorted(key, _keys(keys[i]))])) for i in range(len(keys)) if at[i] is not None], _WEIGHT)

    weighed = sent.filter("part is not null").select("part", "block", "at", "keys", "lost").groupBy("part").applyInArrow(back_off, "block long, at int, weights binary")

    def finish(kept: pa.Table, told: pa.Table) -> pa.Table:
        size, known_, basis, value, held, has_id, ids = unpack(kept["rows"][0].as_py(), np.int64, np.int64, float, float, "u1", "u1", np.int64)
        doc, wish = unpack(kept["lacks"][0].as_py(), np.uint32, np.uint32)
        weight = np.concatenate([unpack(x, float)[0] for x in told.sort_by("at")["weights"].to_pylist()] or [np.zeros(0)])
        value = value + np.bincount(doc, weight[wish], len(value)) if len(doc) else value
        return pa.Table.from_arrays([pa.array(ids, pa.int64(), mask=has_id == 0), pa.array(held > 0), pa.array(size), pa.array(known_), pa.array(np.full(len(ids), n_tokens)), pa.array(basis), pa.array(value)], schema=_OUT)

    kept = sent.filter("part is null").select("block", "rows", "lacks")
    return kept.groupBy("block").cogroup(weighed.groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
