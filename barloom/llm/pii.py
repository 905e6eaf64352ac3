"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The field is trained on the driver from a small labelled table and decoded by Viterbi in numpy batches, each text as one
chain from its first word to its last. A stretch of words with the same features is one step, by a power of its matrix
in max-plus algebra, so common prose costs little and the result is that of word-by-word decoding. The field finds what
the patterns miss: card-like numbers that fail the checksum, phone numbers without a plus, addresses written out ("kim
at host dot org"), and quoted secrets.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import SLICE_BYTES, slices, table, words

KINDS = ("email", "ip", "card", "phone", "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: The labelled table: kind in brackets, filled with numbered examples. Fixed values.
LABELLED = """
the report of monday went to [email] before noon
write to [email] or call [phone] today
please mail [email] , thanks
contact : [email] and ask
her address is [email:out] for now
send it to [email:out] or [email:out] please
server [ip] did not answer
logged in from [ip] at night
host [ip] , port 8080 was open
requests from [ip] and [ip] were seen
paid with [card] last week
card number [card] expires soon
charge [card:group] , then stop
the card [card:group] was lost and [card] found
call [phone] after six
tel [phone:bare] or [phone]
phone : [phone:bare] please
my number is [phone:bare] and hers [phone]
token = [secret] for the build
password = [secret] and more
api_key = [secret] , do not share
secret = [secret] of the job with [email]
and the and over in 1999 and of 2024
it took 12 of 300 people in 45 minutes
chapter 3 , page 117 of the book
version 2.0 of it and 3.1.4 too
licensed under the license , version 2.0 .
number 42 of 1000000 and 7.5 percent
at 10:30 on 2021-05-06 the door
costs 19.99 or 1,250.00 in all
x = 5 and y = 7 of them
section 12.4 of part 3
meet at noon by the dot on the map
she sat at home and the train left at five
look at the wall and at her
the of and was with that from this
ran 400 m in 61 s at the 1988 games
order 123456 of 2020-11-30 in box 9
"""
#: Words whose identity is a feature. Fixed values.
CONTEXT = ("at", "dot", "token", "password", "secret", "api_key", "key", "call", "tel", "phone", "number", "card", "email", "mail", "host", "version", "page", "=", ":")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def labelled_table(copies: int = 10, seed: int = 3) -> list[list[tuple[str, str]]]:
    """Sentences of (word, label): each line of LABELLED, copies times with other examples filled in."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    tail = lambda x: x + pick("", "", "", ",", ".", "&&&", "###")
    names = ("kim", "lee.park", "m_diaz", "jo77", ".34", "r.23", "info", "the.07")

    def example(kind: str) -> list[str]:
        if kind == "email":
            return [tail(f"{pick(*names)}@{pick('mail', 'host', 'mx')}{rng.integers(10)}.{pick('example.com', 'org', 'co.uk')}")]
        if kind == "email:out":
            return [pick("kim", "lee", "diaz", "jo"), "at", pick("mail", "host", "corp"), "dot", pick("com", "org", "net")]
        if kind == "ip":
            return [tail(".".join(str(rng.integers(256)) for _ in range(4)))]
        if kind == "card":
            return [tail(digits(pick(15, 16, 16, 16)))]
        if kind == "card:group":
            return [digits(4), digits(4), digits(4), tail(digits(4))] if rng.random() < 0.5 else [tail("-".join(digits(4) for _ in range(4)))]
        if kind == "phone":
            return pick([f"+{digits(1)}", f"({digits(3)})", tail(f"{digits(3)}-{digits(4)}")], [tail(f"+{digits(2)}-{digits(3)}-{digits(6)}")], [f"+{digits(2)}", digits(3), tail(digits(6))])
        if kind == "phone:bare":
            return pick([f"({digits(3)})", tail(f"{digits(3)}-{digits(4)}")], [tail(f"{digits(3)}-{digits(3)}-{digits(4)}")], [tail(f"{digits(3)}.{digits(3)}.{digits(4)}")])
        return [tail(pick('"', "'").join(["", "".join(rng.choice(list("0123456789abcdef"), pick(24, 32, 40))), ""]))]

    out = []
    for line in LABELLED.strip().splitlines():
        for _ in range(copies):
            sentence = []
            for w in line.split():
                if w[0] == "[":
                    parts, kind = example(w[1:-1]), w[1:-1].split(":")[0]
                    sentence += [(p, ("I-" if i else "B-") + kind) for i, p in enumerate(parts)]
                else:
                    sentence.append((w, "O"))
            out.append(sentence)
    return out


_TAIL = ".,;:!?&%$#*|"
_SPECIAL = re.compile("[0-9@=:]")
#: What the features of a word are made of: shape, itself if it is a word of CONTEXT, digits (20 at most), @ in it,
#: four numbers with dots. PLAIN: any other word; EDGES: what stands before the first and after the last word.
PLAIN, EDGES = ("w", None, 0, False, False), (("<", None, 0, False, False), (">", None, 0, False, False))


def shape(word: str) -> str:
    """d1..d20+ for runs of digits, a for letters, "quoted" for a long quoted key, else itself."""
    core = word.rstrip(_TAIL)
    if re.fullmatch(r"[\"'][0-9A-Za-z_+/=-]{16,}[\"']", core):
        return "quoted"
    return re.sub("[0-9]+", lambda m: f"d{min(len(m[0]), 20)}", re.sub(r"[^\W\d_]+", "a", core))


def attributes(word: str) -> tuple:
    low = word.lower().rstrip(_TAIL) or word[:1]
    special, known = _SPECIAL.search(word), low if low in CONTEXT else None
    if not special:
        return PLAIN if known is None else ("w", known, 0, False, False)
    return shape(word), known, min(sum(ch.isdigit() for ch in word), 20), "@" in word, bool(re.fullmatch(r"\d+(\.\d+){3}\W*", word))


def features_at(before: tuple, own: tuple, after: tuple) -> list[str]:
    """The features of a word from its attributes and its neighbours'."""
    if before == own == after == PLAIN:
        return ["plain"]
    less = lambda x: re.sub(r"d[0-9]+", "d", x)
    s, coarse = own[0], less(own[0])
    f = [f"s{s}", f"c{coarse}", f"b{less(before[0])}", f"a{less(after[0])}", f"n{own[2]}", f"c{coarse}|a{after[0]}", f"c{coarse}|b{before[0]}"]
    f += [f"={own[1]}"] if own[1] else []
    f += [f"p{before[1]}"] if before[1] else []
    f += [f"q{after[1]}"] if after[1] else []
    f += ["@"] if own[3] else []
    f += ["4dots"] if own[4] else []
    return f


def features(window: list[str]) -> list[list[str]]:
    chain = [EDGES[0], *map(attributes, window), EDGES[1]]
    return [features_at(*chain[i : i + 3]) for i in range(len(window))]


class Field:
    """Weights of a linear-chain conditional random field: emissions by feature, transitions, starts."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.emit = np.zeros((len(names) + 1, len(LABELS)))  # the last row: features that training has not seen
        self.move = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """ids: windows x words x features, padded with the number of the last row."""
        return self.emit[ids].sum(2)

    def ids(self, windows: list[list[list[str]]], width: int = 12) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, windows))
        out = np.full((len(windows), longest, width), len(self.names), np.int64)
        for a, window in enumerate(windows):
            for b, fs in enumerate(window):
                known = [self.names[f] for f in fs if f in self.names][:width]
                out[a, b, : len(known)] = known
        return out, np.array([len(x) for x in windows])

    def emission(self, fs: list[str]) -> np.ndarray:
        return self.emit[[self.names[f] for f in fs if f in self.names]].sum(0)

    def viterbi(self, windows: list[list[list[str]]]) -> list[np.ndarray]:
        """The best labels of each window of features."""
        score = [np.array([self.emission(fs) for fs in w]).reshape(-1, len(LABELS)) for w in windows]
        kinds, of = np.unique(np.concatenate(score), axis=0, return_inverse=True) if windows else (np.zeros((0, len(LABELS))), np.zeros(0, np.int64))
        begin = np.cumsum([0, *map(len, windows)])
        paths = [np.zeros(len(w), np.int64) for w in windows]
        for i, at, label in zip(*Chains(self.move).decode(of.reshape(-1), begin, kinds)):
            paths[i][at] = label
        return paths


class Chains:
    """Viterbi over chains of words, stretch by stretch. A stretch is a run of words with the same emission."""

    def __init__(self, move: np.ndarray):
        self.move = move
        self.powers: dict[tuple[int, int], tuple[np.ndarray, float]] = {}

    def power(self, kind: int, n: int) -> tuple[np.ndarray, float]:
        """The best scores of n words of this kind, from each label before them to each label of the last one; and the
        score of those words if all labels are 0."""
        found = self.powers.get((kind, n))
        if found is None:
            if n == 1:
                a = self.move + self.kinds[kind][None]
                found = (a, float(a[0, 0]))
            else:
                (a, x), (b, y) = self.power(kind, n // 2), self.power(kind, n - n // 2)
                found = ((a[:, :, None] + b[None]).max(1), x + y)
            self.powers[kind, n] = found
        return found

    def inside(self, kind: int, n: int, before: int, last: int) -> list[int]:
        """The best labels of a stretch, from the label before it to its last one."""
        a, zeros = self.power(kind, n)
        if n == 1 or (before == last == 0 and a[0, 0] <= zeros + 1e-9):
            return [0] * (n - 1) + [last]
        half = n // 2
        middle = int((self.power(kind, half)[0][before] + self.power(kind, n - half)[0][:, last]).argmax())
        return self.inside(kind, half, before, middle) + self.inside(kind, n - half, middle, last)

    def decode(self, of: np.ndarray, begin: np.ndarray, kinds: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """(chain, word of the chain, label) wherever the best label is not 0, in order. of: the number of each word's
        emission among kinds; begin: where each chain begins (one more than chains)."""
        self.kinds, n_words = kinds, np.diff(begin)
        if not len(of):
            return [], [], []
        if len(self.powers) > 100_000:  # what is kept is bounded; kinds keep their numbers
            self.powers = {}
        new = np.ones(len(of), bool)
        new[1:] = of[1:] != of[:-1]
        new[begin[:-1][n_words > 0]] = True
        new[begin[:-1][n_words > 1] + 1] = True  # the first word has no label before it
        at = np.flatnonzero(new)
        size, kind = np.diff(np.append(at, len(of))), of[at]
        steps = np.searchsorted(at, begin)
        n_steps = np.diff(steps)
        pair, which = np.unique(kind * (1 << 40) + size, return_inverse=True)
        found = [self.power(int(p >> 40), int(p & ((1 << 40) - 1))) for p in pair.tolist()]
        matrix = np.stack([m for m, _ in found])
        trivial = np.array([m[0, 0] <= z + 1e-9 for m, z in found])
        label = np.zeros(len(at), np.int64)
        chains = np.argsort(-n_steps, kind="stable")
        for first in range(0, len(chains), 512):  # chains with about as many steps
            some = chains[first : first + 512]
            some = some[n_steps[some] > 0]
            if not len(some):
                break
            best = kinds[kind[steps[some]]]
            longest = int(n_steps[some[0]])
            back = np.zeros((longest, len(some), len(LABELS)), np.int8)
            live = len(some)
            ends = np.zeros((len(some), len(LABELS)))
            for t in range(1, longest + 1):
                more = int(np.searchsorted(-n_steps[some], -t))  # chains with over t steps
                ends[more:live] = best[more:live]
                live, best = more, best[:more]
                if not live:
                    break
                total = best[:, :, None] + matrix[which[steps[some[:live]] + t]]
                back[t, :live] = total.argmax(1)
                best = total.max(1)
            path = ends.argmax(1)
            for t in range(longest - 1, -1, -1):
                live = int(np.searchsorted(-n_steps[some], -t))
                label[steps[some[:live]] + t] = path[:live]
                path[:live] = back[t, np.arange(live), path[:live]]
        out: tuple[list[int], list[int], list[int]] = [], [], []
        before = np.zeros(len(at), np.int64)
        before[1:] = label[:-1]
        start = np.zeros(len(at), bool)
        start[steps[:-1][n_steps > 0]] = True
        for s in np.flatnonzero((label > 0) | (before > 0) & ~start & (size > 1) | ~trivial[which] & (size > 1)).tolist():
            chain = int(np.searchsorted(begin, at[s], side="right")) - 1
            labels = [int(label[s])] if size[s] == 1 else self.inside(int(kind[s]), int(size[s]), int(before[s]), int(label[s]))
            for k, x in enumerate(labels):
                if x:
                    out[0].append(chain)
                    out[1].append(int(at[s] - begin[chain]) + k)
                    out[2].append(x)
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def expectations(field: Field, ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By forward-backward: the log of each window's sum over all paths, and how often each feature and label, and each
    two labels in a row, are expected over all windows."""
    longest, k = ids.shape[1], len(LABELS)
    score = field.scores(ids)
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = score[:, 0]
    for t in range(1, longest):
        ahead[:, t] = np.where(mask[:, t, None], _logsum(ahead[:, t - 1, :, None] + field.move[None], 1) + score[:, t], ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        behind[:, t] = np.where(mask[:, t + 1, None], _logsum(field.move[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
    z = _logsum(ahead[:, -1], 1)
    p = np.exp(ahead + behind - z[:, None, None]) * mask[:, :, None]
    got = np.zeros_like(field.emit)
    np.add.at(got, ids[mask], p[mask][:, None, :])
    moved = np.zeros((k, k))
    for t in range(1, longest):
        w = ahead[:, t - 1, :, None] + field.move[None] + (score[:, t] + behind[:, t])[:, None, :] - z[:, None, None]
        moved += (np.exp(w) * mask[:, t, None, None]).sum(0)
    return z, got, moved


def train(sentences: list[list[tuple[str, str]]], rounds: int = 120, penalty: float = 0.02) -> Field:
    """Maximum conditional likelihood by forward-backward and Adam, all sentences at once."""
    windows = [features([w for w, _ in s]) for s in sentences]
    names: dict[str, int] = {}
    for window in windows:
        for fs in window:
            for f in fs:
                names.setdefault(f, len(names))
    field = Field(names)
    ids, length = field.ids(windows)
    n, longest, _ = ids.shape
    gold = np.zeros((n, longest), np.int64)
    for a, s in enumerate(sentences):
        gold[a, : len(s)] = [LABELS.index(x) for _, x in s]
    mask = np.arange(longest)[None] < length[:, None]
    k = len(LABELS)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.emit, field.move)]
    gold_emit = np.zeros_like(field.emit)
    np.add.at(gold_emit, (ids[mask], gold[mask][:, None]), 1.0)
    gold_move = np.zeros((k, k))
    both = mask[:, 1:]
    np.add.at(gold_move, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    for step in range(1, rounds + 1):
        _, got, moved = expectations(field, ids, mask)
        for x, g, m in ((field.emit, (gold_emit - got) / n, moments[0]), (field.move, (gold_move - moved) / n, moments[1])):
            g = g - penalty / 10 * x
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += 0.15 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        field.emit[-1] = 0
    return field


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, each kind leftmost and without overlaps, in linear time."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_TRIM = {0: r"[A-Za-z0-9].*[A-Za-z0-9]", 1: r"[0-9].*[0-9]", 2: r"[0-9].*[0-9]", 3: r"[+(0-9].*[0-9]", 4: r"[A-Za-z0-9].*[A-Za-z0-9]"}
#: What a span of the field must have to count.
_VALID = (re.compile(r"@.*\.|\bat\b.*\bdot\b"), re.compile(r"^\d{1,3}(\.\d{1,3}){3}$"), re.compile(r"^(\D?\d){12,19}$"), re.compile(r"^(\D*\d){7,15}\D*$"), re.compile(r"^\S{16,}$"))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Decoder:
    """The field over whole texts. Emissions are kept by the attributes of a word and its neighbours."""

    def __init__(self, field: Field):
        self.field, self.chains = field, Chains(field.move)
        self.attribute: dict[tuple, int] = {PLAIN: 0, EDGES[0]: 1, EDGES[1]: 2}
        self.tuples = [PLAIN, *EDGES]
        self.emission: dict[tuple[int, int, int], int] = {(0, 0, 0): 0}
        self.kinds = [field.emission(features_at(PLAIN, PLAIN, PLAIN))]

    def _attribute(self, word: str) -> int:
        x = attributes(word)
        if x not in self.attribute:
            self.attribute[x] = len(self.tuples)
            self.tuples.append(x)
        return self.attribute[x]

    def labels(self, texts: pa.Array) -> tuple[list[int], list[int], list[int]]:
        """(text, word, label) of all words whose label is not 0."""
        code, distinct, begin = words(texts)
        if not len(code):
            return [], [], []
        if len(self.kinds) > 200_000:  # what is kept is bounded
            self.__init__(self.field)
        own = np.array([self._attribute(w) for w in distinct], np.int64)[code]
        before, after = np.concatenate([[0], own[:-1]]), np.concatenate([own[1:], [0]])
        full = np.diff(begin) > 0
        before[begin[:-1][full]], after[begin[1:][full] - 1] = 1, 2
        of = np.zeros(len(own), np.int64)
        special = np.flatnonzero(before | own | after)
        if len(special):
            triple, which = np.unique(np.stack([before[special], own[special], after[special]], 1), axis=0, return_inverse=True)
            number = np.zeros(len(triple), np.int64)
            for i, x in enumerate(map(tuple, triple.tolist())):
                if x not in self.emission:
                    self.emission[x] = len(self.kinds)
                    self.kinds.append(self.field.emission(features_at(*(self.tuples[y] for y in x))))
                number[i] = self.emission[x]
            of[special] = number[which.reshape(-1)]
        return self.chains.decode(of, begin, np.stack(self.kinds))

    def added_spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the field's spans, as base_spans gives them. A span is trimmed to letters and digits, and
        counts if it has what its kind must have (_VALID)."""
        runs: dict[int, list[list[int]]] = {}
        for i, at, label in zip(*self.labels(pa.array(texts, pa.string()))):
            kind, own = (label - 1) // 2, runs.setdefault(i, [])
            if own and label == 2 * kind + 2 and own[-1][0] == kind and own[-1][2] == at - 1:
                own[-1][2] = at
            else:
                own.append([kind, at, at])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i, own in runs.items():
            places = [m.span() for m in _WORD.finditer(texts[i])]
            for kind, first, last in own:
                a, b = places[first][0], places[last][1]
                m = re.search(_TRIM[kind], texts[i][a:b], re.S)
                if m and _VALID[kind].search(m[0]):
                    out[i].append((a + m.start(), kind, a + m.end()))
        return [sorted(set(x)) for x in out]


def all_spans(base: list[tuple[int, int, int]], added: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans, and the added ones (sorted) that overlap neither them nor an earlier added one."""
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    out, last = list(base), -1
    for a, k, b in added:
        i = bisect_left(starts, b)
        if a >= last and not (i and ends[i - 1] > a):
            out.append((a, k, b))
            last = b
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def trained() -> Field:
    return train(labelled_table())


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs.

    Whole texts are read, of any length, each as one chain. The counts and base_sha256 are of the fixed patterns; spans also has the field's, kind:start:end in code points,
    by start, then kind. A null text counts as empty; rows that repeat give repeated rows; other columns are not
    looked at.
    """
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for part in slices(batches):
            texts = [x or "" for x in part["text"].to_pylist()]
            base = [base_spans(x) for x in texts]
            added = decoder.added_spans(texts)
            count = lambda k: pa.array([sum(s[1] == k for s in x) for x in base], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part["id"], count(0), count(1), count(2), count(3), pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()), pa.array([joined(all_spans(x, y)) for x, y in zip(base, added)], pa.string())],
                ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data in the text replaced by its kind in brackets, as [email]; null stays null.
    A column n_chars, where there is one, counts the new text."""
    field = trained()

    def run(texts):
        import pandas as pd

        decoder = Decoder(field)
        out, values = [], [x if isinstance(x, str) else None for x in texts]
        size = 0
        group: list[str | None] = []
        for x in [*values, "end"]:
            size += len(x or "")
            group.append(x)
            if size > SLICE_BYTES or len(out) + len(group) == len(values) + 1:
                plain = [y or "" for y in group]
                for y, own, more in zip(group, map(base_spans, plain), decoder.added_spans(plain)):
                    if y is not None:
                        pieces, at = [], 0
                        for a, k, b in all_spans(own, more):
                            if a >= at:
                                pieces += [y[at:a], f"[{KINDS[k]}]"]
                            at = max(at, b)
                        y = "".join([*pieces, y[at:]])
                    out.append(y)
                size, group = 0, []
        return pd.Series(out[: len(values)], dtype=object)

    new = docs.withColumn(text_col, F.pandas_udf(run, "string")(text_col))
    return new.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns and text_col == "text" else new


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
