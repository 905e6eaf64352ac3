"""Each operator against brute force on small tables, with nulls, empty texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm.common import stored
from barloom.llm import components, decontaminate, fingerprint, jaccard, katz, licenses, mixing, pii, sentences, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, v long, h long, id long, bucket int"
WORDS = "the of and to in that was his with river stone glass amber quiet window seven garden paper morning".split()


def lines(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "en", "il"]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage = " ".join(lines(rng, 9) for _ in range(8))
    base = lines(rng, 120)
    out = [None, "", " \t\n", "One", "one two three four", "One two  three four", "É" * 500, "ab" * 700, passage, base, base, base.replace("river", "lake", 1)]
    out += [lines(rng, 30) + " " + passage + " " + lines(rng, 20) for _ in range(3)]
    out += [lines(rng, rng.randint(1, 90)) for _ in range(12)]
    words = base.split()
    for k in (3, 10, 40):
        w = list(words)
        w[k] = "changed"
        out.append(" ".join(w))
    out.append(" ".join(lines(rng, 40) for _ in range(200)))  # very long
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", "s" if i % 3 else None, len(t or ""), 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def tokens(x):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(x))


# --- fingerprints ---


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(docs).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        nxt, n = plain[i - 1], len(t) // 3
        r = got[i * 3]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[27].fingerprint == got[30].fingerprint and got[30].near_next == 1.0
    long = got[(len(plain) - 1) * 3]
    assert 0.6 < long.near_edited < 0.7
    sets = fingerprint.chunk_sets([plain[-1]])[0]
    assert fingerprint.unpack(fingerprint.pack(sets)) == sets
    assert fingerprint.fingerprints(docs).filter("doc_id = 0").first().fingerprint == ""


def test_chunks_cover_the_text_and_resist_shifts(texts):
    x = (texts[-1]).encode()
    ends = fingerprint.chunk_ends(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0]
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(x) and sizes.max() <= fingerprint.MOST and sizes[:-1].min() >= fingerprint.LEAST
    a, b = fingerprint.chunk_sets([texts[-1], "shifted by some words " + texts[-1]])
    assert fingerprint.containment(a, b) > 0.98


def test_fingerprints_of_odd_tables(spark, empty):
    assert fingerprint.compare_with_edits(empty).count() == 0
    rows = [(1, "a" * 9), (1, "b" * 9), (None, "c" * 9), (1, "a" * 9)]
    out = fingerprint.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 4
    one = fingerprint.compare_with_edits(spark.createDataFrame(rows[:1], "doc_id long, text string")).first()
    assert one.near_next == 1.0


# --- personal data ---


def brute_spans(x):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, x):
            d = "".join(c for c in m[0] if c.isdigit())
            if (k != 1 or all(int(y) <= 255 for y in m[0].split("."))) and (k != 2 or (12 <= len(d) <= 19 and pii.luhn(d))) and (k != 3 or 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_patterns_match_brute_force():
    rng = random.Random(2)
    for _ in range(3000):
        x = "".join(rng.choice("ab12.@-+ ()4é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(x) == brute_spans(x), x


def test_field_on_lines_held_out(monkeypatch):
    every = pii.LABELLED.strip().splitlines()
    right = total = 0
    for k in (0, 4):  # whole lines of the table that training does not see
        own = every[k::7]
        monkeypatch.setattr(pii, "LABELLED", "\n".join(x for x in every if x not in own))
        field = pii.trained()
        monkeypatch.setattr(pii, "LABELLED", "\n".join(own))
        held_out = pii.labelled_table(5, seed=77)
        for sentence, path in zip(held_out, field.viterbi([pii.features([w for w, _ in s]) for s in held_out])):
            right += sum(pii.LABELS[a] == b for a, (_, b) in zip(path, sentence))
            total += len(sentence)
    assert right / total > 0.95


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    for n in (1, 2, 3, 4):
        field = pii.Field({f"f{i}": i for i in range(4)})
        field.emit[:-1], field.move = rng.normal(size=(4, k)), rng.normal(size=(k, k))
        for _ in range(10):
            window = [[f"f{x}"] for x in rng.integers(0, 2, n)]
            score = np.stack([field.emission(f) for f in window])
            paths = np.stack([x.ravel() for x in np.meshgrid(*[np.arange(k)] * n, indexing="ij")], 1)
            value = score[np.arange(n), paths].sum(1) + field.move[paths[:, :-1], paths[:, 1:]].sum(1)
            assert field.viterbi([window])[0].tolist() == paths[value.argmax()].tolist()
    # stretches of thousands of words: as word by word
    field.move = rng.normal(size=(k, k)) * 0.1
    window = [["f0"]] * 5000 + [["f1"]] * 3 + [["f0"]] * 777 + [["f2"]]
    score = np.stack([field.emission(f) for f in window])
    best, back = score[0], []
    for e in score[1:]:
        total = best[:, None] + field.move
        back.append(total.argmax(0))
        best = total.max(0) + e
    path = [int(best.argmax())]
    for x in reversed(back):
        path.append(int(x[path[-1]]))
    got = field.viterbi([window, window[4990:], []])
    value = lambda p: score[np.arange(len(p)), p].sum() + field.move[p[:-1], p[1:]].sum()
    assert math.isclose(value(got[0]), value(np.array(path[::-1])), rel_tol=1e-12) and len(got[2]) == 0


def test_expectations_are_the_gradient():
    rng = np.random.default_rng(1)
    windows = [pii.features([w for w, _ in s]) for s in pii.labelled_table(1)[:12]]
    field = pii.Field({f: i for i, f in enumerate(dict.fromkeys(f for w in windows for fs in w for f in fs))})
    field.emit[:-1], field.move = rng.normal(size=field.emit[:-1].shape), rng.normal(size=field.move.shape)
    ids, length = field.ids(windows)
    mask = np.arange(ids.shape[1])[None] < length[:, None]
    _, got, moved = pii.expectations(field, ids, mask)
    for values, slope in ((field.emit, got), (field.move, moved)):
        for _ in range(12):
            i = rng.integers(len(values) - 1), rng.integers(len(pii.LABELS))
            total = []
            for step in (1e-5, -2e-5):
                values[i] += step
                total.append(pii.expectations(field, ids, mask)[0].sum())
            values[i] += 1e-5
            assert math.isclose((total[0] - total[1]) / 2e-5, slope[i], rel_tol=1e-4, abs_tol=1e-6)


def test_pii_of_long_texts_is_as_of_short_ones():
    decoder = pii.Decoder(pii.trained())
    short = "please call (555) 123-4567 today or write to kim at host dot org , thanks"
    filler = "the of and river stone glass " * 3000
    alone, inside = decoder.added_spans([short, filler + short + " " + filler])
    assert alone and inside == [(a + len(filler), k, b + len(filler)) for a, k, b in alone]
    many = [(i * 10, 0, i * 10 + 5) for i in range(20000)]
    assert len(pii.all_spans(many, [(a + 6, 1, a + 8) for a, _, _ in many] + [(10**6, 1, 10**6 + 3)])) == 40001
    assert pii.all_spans([(0, 1, 50), (5, 3, 9)], [(20, 2, 30), (50, 2, 60)]) == [(0, 1, 50), (5, 3, 9), (50, 2, 60)]


def test_pii_rows(spark, empty):
    rows = [(1, "mail a.b@c.de now"), (2, 'é token = "0123456789abcdef0123456789abcdef" end'), (3, None), (3, None), (4, "card 4242 4242 4242 4242, or 1234567812345678")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].spans == "email:5:13" and got[0].n_email == 1
    assert got[1].spans.startswith("secret:11:43") and got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].spans.split(",")[0] == "card:5:24" and len(got[4].spans.split(",")) == 2
    clean = pii.redact(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))).orderBy("doc_id").collect()
    assert clean[0].text == "mail [email] now" and clean[0].n_chars == 16 and clean[2].text is None
    assert pii.find_pii(empty).count() == 0 and pii.redact(empty).count() == 0


# --- language model ---


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_matches_brute_force(docs, texts, spark, empty, order):
    got = {r.doc_id: r for r in katz.score(docs.repartition(5), order=order).collect()}
    tok = {i * 3: [*tokens(t), "\n"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tok}
    count = [collections.Counter() for _ in range(order + 1)]  # by length; the history's is that of its followers
    for i, w in tok.items():
        if not held[i]:
            w = ["\t", *w]
            for n in range(1, order + 1):
                count[n].update(tuple(w[k - n + 1 : k + 1]) for k in range(1, len(w)) if k - n + 1 >= 0)
    n_tokens, v = sum(count[1].values()), len(count[1])
    of = lambda c: np.array([sum(x == r for x in c.values()) for r in range(1, 7)])
    d = [None, *(katz.discounts(of(c)) for c in count[1:])]
    less = lambda c, n: float(katz.discounted(np.array([c]), d[n])[0])
    follow = collections.defaultdict(dict)
    for c in count[1:]:
        for g, x in c.items():
            follow[g[:-1]][g[-1]] = x
    unknown = 1 - sum(less(c, 1) for c in count[1].values()) / n_tokens

    def prob(h, w):
        if not h:
            return less(count[1][w,], 1) / n_tokens if (w,) in count[1] else unknown
        if h not in follow:
            return prob(h[1:], w)
        if w in follow[h]:
            return less(follow[h][w], len(h) + 1) / sum(follow[h].values())
        if h not in weight:
            weight[h] = (1 - sum(prob(h, x) for x in follow[h])) / (1 - sum(prob(h[1:], x) for x in follow[h]))
        return weight[h] * prob(h[1:], w)

    weight = {}
    for h in [h for h in follow if h][:: max(1, len(follow) // 20)]:
        assert math.isclose(sum(prob(h, w) for (w,) in count[1]) + prob(h, "unseen"), 1, rel_tol=1e-9)
    for i, w in tok.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum((x,) in count[1] for x in w), n_tokens)
        padded = ["\t", *w]
        want = sum(math.log10(prob(tuple(padded[max(0, k - order + 1) : k]), padded[k])) for k in range(1, len(padded)))
        assert math.isclose(r.score, want, rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((count[1][x,] + 0.5) / (n_tokens + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    assert katz.score(empty, order=order).count() == 0
    odd = katz.score(spark.createDataFrame([(3, "a b"), (3, "a b"), (None, None)], "doc_id long, text string"), order=order).collect()
    assert len(odd) == 3 and sum(r.doc_id is None for r in odd) == 1


# --- mixing ---


def test_mix_is_pfair(spark, empty):
    docs = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").otherwise(F.lit(None)).alias("source"), F.lit("x").alias("mix_slot"))
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("", 2.0)], "source string, weight double")
    rows = mixing.mix(docs, weights, period=100, block_docs=4, group_docs=100).collect()
    assert len(rows) == 4000 and len({(r.mix_slot, r.mix_offset) for r in rows}) == 4000
    slots = {r.mix_slot: r.source for r in rows}
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)
    share = {"a": 0.5, "b": 0.3, None: 0.2}
    seen = collections.Counter()
    for t in range(400):
        seen[slots[t]] += 1
        assert all(abs(seen[s] - (t + 1) * share[s]) < 1.02 for s in share)
    assert mixing.mix(empty, mixing.target_weights(empty)).count() == 0


def test_mix_keeps_to_target_weights(spark):
    # one of 20 sources holds a third of the rows; a further one has no weight
    size = {f"s{k:02}": 38 for k in range(19)} | {"hot": 361}
    names = [s for s, n in size.items() for _ in range(n)] + ["none"] * 3
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "doc_id long, source string")
    weight = {s: math.sqrt(n) for s, n in size.items()}
    weights = spark.createDataFrame([*weight.items(), ("none", 0.0)], "source string, weight double")
    rows = mixing.mix(docs, weights, period=64, block_docs=1).collect()
    slots = {r.mix_slot: r.source for r in rows}
    assert len(slots) == len(rows) == len(names)
    assert [slots[t] for t in sorted(slots)[-3:]] == ["none"] * 3
    for r in rows:
        if r.source != "none":
            w = weight[r.source] / sum(weight.values())
            assert abs(r.mix_release - math.floor(r.mix_block / w + 1e-6)) == abs(r.mix_deadline - math.ceil((r.mix_block + 1) / w - 1e-6)) == 0
            assert r.mix_release <= r.mix_slot < r.mix_deadline
    # the schedule itself, over slots enough for a weight of three digits to go astray
    blocks = spark.createDataFrame([(s, 1) for s in size if s != "hot"] + [("hot", 700)], "source string, blocks long")
    seen = collections.Counter()
    plan = mixing.schedule(weights, blocks).orderBy("slot").collect()
    assert len(plan) > 4000
    for t, r in enumerate(plan):
        seen[r.source] += 1
        assert r.slot == t and all(abs(seen[s] - (t + 1) * w / sum(weight.values())) < 1 for s, w in weight.items())


def test_mix_of_more_sources_than_a_period(spark):
    docs = spark.range(0, 1500).select(F.col("id").alias("doc_id"), F.format_string("s%04d", F.col("id")).alias("source"))
    rows = mixing.mix(docs, mixing.target_weights(docs)).collect()
    assert {r.mix_slot for r in rows} == set(range(1500))


# --- decontamination ---


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i]
        for j in range(1, len(t) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
        row = new
    return min(row)


def test_leaks_match_brute_force(spark, empty):
    rng = random.Random(4)
    items = [(i, lines(rng, 12)) for i in range(6)] + [(6, ""), (7, None)]
    rows = [(0, None), (1, ""), (2, lines(rng, 50))]
    for i in range(20):
        x = list(items[i % 6][1])
        for _ in range(rng.randint(0, 8)):
            x[rng.randrange(len(x))] = rng.choice("abcxyz")
        rows.append((10 + i, lines(rng, 10) + " " + "".join(x) + " " + lines(rng, 10)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
    for chars in (10**6, 100):
        got = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(docs, bench, chars=chars).collect())
        want = []
        for i, t in [*rows, rows[3]]:
            for k, p in items:
                p = decontaminate.normal(p)
                d = edit_distance(p, decontaminate.normal(t)) if p and t else 99
                if p and d <= int(len(p) * decontaminate.ERROR_RATE):
                    want.append((i, k, d))
        assert got == sorted(want) and got
    assert decontaminate.without_leaks(docs, bench, chars=100).count() == decontaminate.without_leaks(docs, bench).count()
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _, _ in got}
    long = spark.createDataFrame([(1, "of the river " * 40000 + items[2][1], 7)], "doc_id long, text string, item_id long")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(long, bench).collect()] == [(1, 2, 0)]
    assert decontaminate.without_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


# --- toxicity ---


def test_toxicity_learns_words_and_beginnings(spark, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.2
        words = lines(rng, 30).split()
        if bad:
            words[rng.randrange(30)] = rng.choice(["vexor", "grumpling" + rng.choice("abcdef"), "Vexor,"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad != (rng.random() < 0.02))))
    docs = spark.createDataFrame([*rows, (None, None), (1000, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    truth = {i: any(w in t.lower() for w in ("vexor", "grumpling")) for i, t in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(bool(r.predicted) == truth[r.doc_id] for r in held) / len(held) > 0.97
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 1
    assert toxicity.toxicity(empty, marks).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0.5}


def test_texts_are_dropped_from_the_cut_that_tells_labels_apart():
    """Even odds where labels are apart; else lower ones that lose few clean texts and find more toxic ones."""
    apart = np.array([-5.0] * 90 + [4.0] * 10)
    label = np.array([0] * 90 + [1] * 10)
    assert toxicity.clean_cut(apart, label) == 0
    mixed = np.concatenate([np.linspace(-8, -4, 87), [-1.0, -0.5, 1.0], np.full(6, 3.0), np.full(3, -2.0), [-7.0]])
    assert toxicity.clean_cut(mixed, label) == -2  # nine of ten toxic texts for two clean ones
    few = np.concatenate([np.linspace(-8, -4, 80), np.full(10, -1.5), np.full(6, 3.0), np.full(4, -2.0)])
    assert toxicity.clean_cut(few, label) == 0  # all toxic texts would cost more than KEPT_CLEAN allows


def test_the_classifier_is_fitted_in_blocks_of_rows(monkeypatch):
    """The driver holds a block of rows as doubles, not the matrix, with the same weights."""
    rng = np.random.default_rng(8)
    x, q = (rng.random((500, 7)) < 0.3).astype(np.uint8), rng.random(500)
    whole = toxicity.fit_linear(x, q)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 64)
    assert np.allclose(whole, toxicity.fit_linear(x, q), atol=1e-12)


def planted_votes(rng, n, rates):
    """Rows with a hidden class, votes by the class's rates (the last voter mostly follows the first), a noisy label."""
    truth = np.array([rng.random() < 0.3 for _ in range(n)])
    votes = np.array([[rng.random() < rates[int(c)][j] for j in range(len(rates[0]))] for c in truth], float)
    votes[:, -1] = [a if rng.random() < 0.9 else b for a, b in zip(votes[:, 0], votes[:, -1])]
    return truth, votes, np.array([int(c != (rng.random() < 0.25)) for c in truth])


def test_label_model_steps_match_brute_force():
    rng = random.Random(3)
    rates = ([0.05, 0.1, 0.02, 0.08, 0.05, 0.1], [0.6, 0.5, 0.3, 0.7, 0.4, 0.5])
    truth, v, label = planted_votes(rng, 400, rates)
    q = np.array([rng.random() for _ in range(400)])

    def share(c, **seen):  # weighted share of rows of class c with these votes
        w = q if c else 1 - q
        return sum(w[i] for i in range(400) if all(v[i, int(j[1:])] == x for j, x in seen.items())) / w.sum()

    def information(a, b):
        out = 0.0
        for c in (0, 1):
            for x, y in itertools.product((0, 1), (0, 1)):
                joint = share(c, **{f"v{a}": x, f"v{b}": y})
                if joint > 0:
                    out += (q if c else 1 - q).sum() / 400 * joint * math.log(joint / share(c, **{f"v{a}": x}) / share(c, **{f"v{b}": y}))
        return out

    pairs = {(a, b): information(a, b) for a, b in itertools.combinations(range(6), 2)}
    best = 0.0
    for edges in itertools.combinations(pairs, 5):  # all trees on six voters
        reached = {0}
        for _ in range(5):
            reached |= {y for e in edges for y in e if set(e) & reached}
        if len(reached) == 6:
            best = max(best, sum(pairs[e] for e in edges))
    parent = toxicity.voter_tree(v, q)
    assert sorted(parent)[0] == -1 and (parent >= 0).sum() == 5
    assert math.isclose(sum(pairs[tuple(sorted((j, int(p))))] for j, p in enumerate(parent) if p >= 0), best, rel_tol=1e-6)

    got = toxicity.update(v, label, q, parent, 0.7)
    for i in range(0, 400, 7):
        chance = []
        for c in (0, 1):
            w = q if c else 1 - q
            p = (w.sum() + 0.5) / 401 * (0.7 if label[i] == c else 0.3)
            for j in range(6):
                above = 0 if parent[j] < 0 else v[i, parent[j]]
                like = [r for r in range(400) if (0 if parent[j] < 0 else v[r, parent[j]]) == above]
                rate = (sum(w[r] for r in like if v[r, j] == 1) + 0.2) / (sum(w[r] for r in like) + 1)
                p *= rate if v[i, j] == 1 else 1 - rate
            chance.append(p)
        assert math.isclose(got[i], chance[1] / sum(chance), rel_tol=1e-9)


def test_label_model_learns_from_agreement():
    rng = random.Random(4)
    rates = ([0.03, 0.05, 0.02, 0.04, 0.05, 0.03, 0.02, 0.05], [0.5, 0.45, 0.4, 0.6, 0.5, 0.55, 0.4, 0.5])
    truth, votes, label = planted_votes(rng, 3000, rates)
    q = toxicity.label_model(votes, label)
    assert ((label == 1) == truth).mean() < 0.78 < 0.96 < ((q >= 0.5) == truth).mean()
    assert toxicity.distinct_voters(np.hstack([votes, votes[:, :3]])) == list(range(7))  # the last is like the first
    assert set(toxicity.label_model(votes[:, :2], label)) == {toxicity.LABEL_ALONE, 1 - toxicity.LABEL_ALONE}


def test_toxicity_of_long_repeated_and_clashing_rows(spark):
    rng = random.Random(6)
    bad = ["vexor", "grumpl", "snidge", "plonk"]
    rows = []
    for i in range(400):
        words = lines(rng, 30).split()
        if i % 4 == 0:
            words[3:6] = rng.sample(bad, 3)
        rows.append((i, " ".join(words), 0.5, 1))
    long = " ".join(lines(rng, 60) for _ in range(3000))
    rows += [(1000, long, 0.1, 0), (1001, long + " vexor grumpl snidge plonk", 0.1, 0), rows[4], rows[4], (None, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, toxic int")
    marks = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(400)] * 2, "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.predicted)
    assert all(by[i] == {int(i % 4 == 0)} for i in range(400)) and by[1000] == {0} and by[None] == {0}
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows if by[r[0]] == {0}}


# --- sentence spans ---


def test_sentence_spans_match_brute_force(docs, texts, empty):
    got = {r.doc_id: r for r in sentences.span_dedup(docs).collect()}
    seen, gone = set(), collections.defaultdict(set)
    for i, t in enumerate(texts):
        parts = sentences.split(t)
        assert "".join(parts) == (t or "")
        for h, place, n in sentences.run_hashes(parts, 3, 10):
            if h in seen:
                gone[i * 3].update(range(place, place + n))
            seen.add(h)
    for i, t in enumerate(texts):
        r = got[i * 3]
        assert r.removed == sorted(gone[i * 3])
        assert r.text == (t if not r.removed else "".join(s for k, s in enumerate(sentences.split(t)) if k not in gone[i * 3]))
    assert sum(map(len, gone.values())) > 20
    assert sentences.span_dedup(empty).count() == 0
    twice = sentences.span_dedup(docs.unionAll(docs)).groupBy("doc_id").agg(F.min("n_removed"), F.max("n_removed")).filter("doc_id = 24").first()
    assert twice[2] > twice[1] == 0


def test_repeated_passages_of_short_and_of_two_sentences_go(spark):
    short = " ".join(f"W{i} go!" for i in range(30))
    two = "The quiet river runs past the old mill. Nobody has seen the miller since spring."
    uneven = "One two three four five six. Seven eight nine. Ten eleven twelve thirteen fourteen fifteen."
    rows = [short, short, f"A first text begins here. {two} It ends here.", f"Another one has it too. {two} So it goes on.", uneven, f"Before. {uneven} After."]
    got = [r.removed for r in sentences.span_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [[], list(range(30)), [], [1, 2], [], [1, 2, 3]]
    rng = random.Random(2)
    for _ in range(300):  # every sentence of a repeated passage is in a run of the passage
        passage = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 8))) + ". " for _ in range(rng.randint(2, 12))]
        if len(sentences.plain("".join(passage)).split()) < 10:
            continue
        a, b = ([f"Start{x} here. "] + passage + [f"End{x} there."] for x in (1, 2))
        runs = {h for h, _, _ in sentences.run_hashes(a, 3, 10)}
        assert {i for h, p, n in sentences.run_hashes(b, 3, 10) if h in runs for i in range(p, p + n)} >= set(range(1, len(passage) + 1))


# --- licences ---


def test_licences(spark, empty):
    notice = licenses.TEMPLATES["gpl-3.0-notice"]
    rows = [(1, "Some words. " + notice + " More."), (2, notice.replace("redistribute", "spread").replace("either", "any")), (3, None), (4, "the license of the work is under the version"), (5, "Released under the MIT License. " * 2)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = collections.Counter((r.doc_id, r.license) for r in got)
    assert by == {(1, "gpl-3.0-notice"): 1, (2, "gpl-3.0-notice"): 1, (5, "mit-statement"): 2}
    exact = next(r for r in got if r.doc_id == 1)
    assert exact.coverage == 1.0 and rows[0][1][exact.start : exact.end] == notice.rstrip(".")
    assert licenses.scan(empty).count() == 0
    a, b = "x a b c d e".split(), "a q b d c e e".split()
    assert all(a[i] == b[j] for i, j in licenses.align(a, b)) and len(licenses.align(a, b)) >= 4


# --- Jaccard ---


def test_signatures_never_miss():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        n = int(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 60, 200, 280, 500]))
        a = set(rng.integers(0, 2**63, n).tolist())
        k = int(rng.integers(0, n // 5 + 2))
        cut = int(rng.integers(0, k + 1))
        b = set(list(a)[cut:]) | set(rng.integers(0, 2**63, k - cut).tolist())
        if not b or a == b or 100 * len(a & b) < 80 * len(a | b):
            continue
        h = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in (a, b)])
        begin = np.array([0, len(a), len(a) + len(b)])
        for doubled in (frozenset(), frozenset(jaccard.bands()[k + 1] - 1 for k in range(40)), frozenset(jaccard.bands()[k + 1] - 1 for k in range(0, 40, 2))):
            doc, sig = jaccard.signatures(h, begin, doubled)
            assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist())
        m = np.zeros(2, jaccard._MEMBER)
        m["size"], m["bits"] = [len(a), len(b)], jaccard.parity_bits(h, begin)
        assert jaccard.may_link(m[0], m[1:])[0]


def brute_components(texts):
    sets = []
    for t in texts:
        w = tokens(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_near_duplicates_match_brute_force(spark, texts, docs, empty):
    rng = random.Random(3)
    more = list(texts)
    for _ in range(6):  # families whose members are near or just not near
        base = [rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.choice([12, 40, 150, 400]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = "new" + str(rng.random())
            more.append(" ".join(w))
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(more)], "doc_id long, text string, v long")
    sizes, roots = brute_components(more)
    got = {r.doc_id: r for r in jaccard.near_duplicates(df).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(more))] == list(zip(sizes, roots))
    first = jaccard.one_of_each(df)
    assert first.columns == df.columns and sorted(r.doc_id for r in first.collect()) == sorted(i for i, r in enumerate(roots) if i == r)
    assert jaccard.near_duplicates(empty).count() == 0


def test_large_sets_that_link_to_one_base_only(spark):
    rng = random.Random(17)
    base = [f"w{rng.randrange(10**6)}" for _ in range(604)]
    rows = [" ".join(base)]
    for v in range(200):
        own = list(base)
        for k in range(13):  # 65 of 600 shingles: 535 / 665 is over 0.8, two of these have about 470 / 730
            own[40 + 43 * k + rng.randrange(38)] = f"x{v}-{k}"
        rows.append(" ".join(own))
    sets = [set(zip(*(r.split()[i:] for i in range(5)))) for r in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert links == [(a, 0) for a in range(1, len(sets))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert got == dict.fromkeys(range(len(rows)), 0)


def test_template_family_makes_few_pairs(spark):
    # 600 texts of 500 words share 300 of them: lists are long, no two texts link, and one pair does
    rng = random.Random(23)
    shared = [f"t{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for v in range(600):
        own = list(shared)
        own[150:150] = [f"o{v}-{k}" for k in range(200)]
        rows.append(" ".join(own))
    rows[599] = rows[598].replace("o598-7 ", "x ")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    base = df.select("doc_id", "text", F.xxhash64("text").alias("t"))
    met = stored(jaccard._meet(jaccard._sets_and_postings(base, frozenset(), 4), 4), "hits")
    assert met.filter("gid is not null").count() > 0  # lists over the limit
    maps = met.filter("maps is not null").select("to", "keys", "maps")
    none = spark.createDataFrame([], "v long, root long")
    made = jaccard.strays(met.filter("gid is not null"), maps, none, 4).collect()
    assert sum(len(r.pairs) for r in made) // jaccard._PAIR.itemsize < 600  # of 179700
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert got == {i: min(i, 598) for i in range(600)}


def test_tiles_let_all_strays_meet():
    star = np.zeros(25, jaccard._PLACE)
    star["tile"], star["key"], star["root"] = 5, np.arange(25), [0] * 12 + list(range(12, 25))
    met = set()
    for tile in jaccard.tiles(star, 4):
        for a in tile:
            for b in tile:
                if a["root"] != b["root"] and (a["side"] != b["side"] or not tile["side"].any()):
                    met.add((int(a["key"]), int(b["key"])))
    assert met == {(a, b) for a in range(25) for b in range(25) if star["root"][a] != star["root"][b]}
    assert jaccard.tiles(star[:12], 4) == []


def test_one_of_each_goes_by_rows(spark):
    words = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abtn"}
    rows = [(1, words["a"], "p"), (5, words["a"] + " x", "q"), (5, words["b"], "r"), (7, words["t"], "s"), (7, words["t"], "u"), (None, words["n"], "v"), (None, words["n"], "w"), (8, "", "x"), (8, None, "y"), (None, words["a"], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(1, words["a"]), (5, words["b"]), (7, words["t"]), (None, words["n"]), (8, ""), (8, None)], key=str)
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_link_through_a_null_id(spark):
    base = [f"w{i}" for i in range(104)]
    a, c = list(base), list(base)
    a[20], c[70] = "x", "y"  # each has 90 of 110 shingles in common with base, but 80 of 120 with each other
    a[40], c[90] = "x", "y"
    rows = [(1, " ".join(a)), (None, " ".join(base)), (2, " ".join(c)), (None, "some other text that is quite alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(zip(*(r.split()[i:] for i in range(5)))) for _, r in rows[:3]]
    linked = lambda x, y: 10 * len(x & y) >= 8 * len(x | y)
    assert linked(sets[0], sets[1]) and linked(sets[1], sets[2]) and not linked(sets[0], sets[2])
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect()} == {(1, 1), (2, 1), (None, 1), (None, None)}


def test_components(spark, empty):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + rng.randint(1, 30)) for _ in range(40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[b] == 100 for a, b in pairs if a == 100) and got[201] == 200
    assert components.components(empty.select(F.col("v").alias("a"), F.col("h").alias("b"))).count() == 0


# --- suffixes ---


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(200):
        x = np.array([rng.choice([97, 98, 99, 100][: rng.randint(1, 4)]) for _ in range(rng.randint(1, 100))], np.uint8)
        wanted = np.array([rng.random() < 0.6 for _ in x])
        raw = x.tobytes()
        assert suffixes.suffix_order(x, wanted).tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: raw[i:])


@pytest.mark.parametrize("span,gram,shared,hot", [(400, 128, 400, 1000), (400, 64, 240, 1000), (40, 16, 40, 1000), (40, 16, 24, 2), (40, 16, 30, 0)])
def test_repeats_match_brute_force(docs, texts, empty, span, gram, shared, hot):
    got = {r.doc_id: r for r in suffixes.repeats(docs, span, gram, shared=shared, hot=hot).collect()}
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[k : k + span] for b in raw for k in range(len(b) - span + 1))
    rows_of = collections.Counter(x for b in raw for x in {b[k : k + shared] for k in range(len(b) - shared + 1)})
    for i, b in enumerate(raw):
        cover, common = np.zeros(len(b), bool), np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if count[b[k : k + span]] > 1:
                cover[k : k + span] = True
        for k in range(len(b) - shared + 1):
            if rows_of[b[k : k + shared]] > 1:
                common[k : k + shared] = True
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        r = got[i * 3]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest())
        assert r.n_shared == int(common.sum())
    assert suffixes.repeats(empty).count() == 0
    twice = suffixes.repeats(docs.unionAll(docs)).filter("doc_id = 27").collect()
    assert len(twice) == 2 and all(r.n_removed == r.n_bytes == r.n_shared for r in twice)


def test_short_texts_only(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (3, "a")], "doc_id long, text string")
    assert {(r.n_removed, r.n_shared, r.n_spans) for r in suffixes.repeats(rows).collect()} == {(0, 0, 0)}
    assert {(r.n_removed, r.n_shared) for r in sentences.span_dedup(rows).collect()} == {(0, 0)}
