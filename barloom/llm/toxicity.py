"""Toxicity by weak supervision.

Voters are lexicon words and word beginnings that are right in most of the labelled training texts they are in. A
generative label model, a tree-shaped network over the voters given the hidden class, begins with the number of votes
a text has and estimates by expectation-maximisation, from the voters' agreement, how accurate each voter is and how it
depends on the voter it is most correlated with. The given label only tells the classes apart: it has a fixed, weak
weight (LABEL_TRUST), which is not learned. The posterior labels train a linear classifier over word and beginning
features, which scores every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import discard, slices, stored, table, words

#: At most so many labelled rows are learned from (those with the least hash of their id).
MAX_LABELLED = 20_000
#: Features of the classifier: with most evidence for and against toxicity.
FEATURES_FOR, FEATURES_AGAINST = 400, 100
#: At most so many voters, each right in VOTER_PRECISION of its labelled texts at least, no two in VOTER_OVERLAP of
#: the texts that either is in.
VOTERS, VOTER_PRECISION, VOTER_OVERLAP = 160, 2 / 3, 0.8
#: Votes that make a text certainly toxic at the start.
CERTAIN = 4
#: How often the label model takes a given label to be right. With fewer voters than three, whose agreement can't be
#: told from chance, the label decides alone, right in LABEL_ALONE.
LABEL_TRUST, LABEL_ALONE = 0.7, 0.95
#: Share of the texts labelled clean that dropping toxic ones keeps at least.
KEPT_CLEAN = 0.95
#: Rows of the classifier's matrix that the driver holds as doubles at a time.
BLOCK_ROWS = 1024
#: Lengths of word beginnings that count as patterns.
BEGINNINGS = (3, 4, 5, 6)
_LETTERS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The features that a word (already split at blanks) has: its runs of letters and their beginnings."""
    out = []
    for x in _LETTERS.findall(word.lower()):
        out.append(f"={x}")
        out += [x[:n] for n in BEGINNINGS if len(x) > n]
    return out


def document_features(texts: pa.Array, known: dict[str, int] | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Distinct (document, feature) pairs and the names of the features; only known ones if they are given."""
    code, distinct, begin = words(texts)
    names: dict[str, int] = {} if known is None else known
    lists = []
    for w in distinct:
        found = features_of(w)
        lists.append({names.setdefault(x, len(names)) for x in found} if known is None else {names[x] for x in found if x in names})
    count = np.array([len(x) for x in lists] or [0], np.int64)
    flat = np.fromiter((y for x in lists for y in x), np.int64, int(count.sum()))
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(texts)), np.diff(begin))
    has = np.flatnonzero(count[code]) if len(code) else np.zeros(0, np.int64)
    n = count[code[has]] if len(has) else np.zeros(0, np.int64)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pair = np.repeat(doc[has], n) * max(len(names), 1) + flat[np.repeat(first[code[has]], n) + step] if len(has) else np.zeros(0, np.int64)
    pair = np.unique(pair)
    return pair // max(len(names), 1), pair % max(len(names), 1), list(names)


def training_rows(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from: crc32(id as text) mod 5 is not 0, the most with least hash."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")  # at most `most` small rows


def count_features(rows: DataFrame) -> DataFrame:
    """(feature, pos, neg): in how many toxic and other texts of rows each feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            doc, feature, names = document_features(part["text"], None)
            toxic = part["toxic"].to_numpy(zero_copy_only=False)[doc]
            pos = np.bincount(feature[toxic == 1], minlength=len(names))
            neg = np.bincount(feature[toxic == 0], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pos.astype(np.int64)), pa.array(neg.astype(np.int64))], ["feature", "pos", "neg"])

    return rows.mapInArrow(run, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_features(counts: DataFrame, n_pos: int, n_neg: int) -> list[str]:
    """The features with most evidence (log odds by their standard error), those for toxicity first."""
    p, n = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(p / (F.lit(n_pos + 1) - p)) - F.log(n / (F.lit(n_neg + 1) - n))
    scored = counts.filter(F.col("pos") + F.col("neg") >= 5).withColumn("z", odds / F.sqrt(1 / p + 1 / n))
    top = scored.filter("z > 2").orderBy(F.desc("z"), "feature").limit(FEATURES_FOR).select("feature").collect()
    low = scored.filter("z < -2").orderBy("z", "feature").limit(FEATURES_AGAINST).select("feature").collect()
    return [r[0] for r in top + low]


def voter_candidates(counts: DataFrame, n_pos: int, n_neg: int, most: int = 400) -> list[str]:
    """Features right in VOTER_PRECISION of five texts or more, those first whose counts are least like chance (the
    likelihood ratio of the two-by-two table)."""
    p, n, every = F.col("pos"), F.col("neg"), float(n_pos + n_neg)
    cells = [(p, n_pos, p + n), (n, n_neg, p + n), (n_pos - p, n_pos, every - p - n), (n_neg - n, n_neg, every - p - n)]
    ratio = sum(F.when(seen > 0, seen * F.log(seen * every / (total * marked))).otherwise(0.0) for seen, total, marked in cells)
    good = counts.filter((p + n >= 5) & (p >= VOTER_PRECISION * (p + n)) & (p * n_neg > n * n_pos))
    return [r[0] for r in good.orderBy(F.desc(ratio), "feature").limit(most).select("feature").collect()]


def distinct_voters(x: np.ndarray, most: int = VOTERS, overlap: float = VOTER_OVERLAP) -> list[int]:
    """The first columns of x (0/1), but those that share too many of their rows with one before."""
    both = x.T @ x
    one = np.diag(both)
    alike = both / np.maximum(one[:, None] + one[None, :] - both, 1)
    chosen: list[int] = []
    for j in range(x.shape[1]):
        if len(chosen) < most and all(alike[j, i] < overlap for i in chosen):
            chosen.append(j)
    return chosen


def voter_tree(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each voter's parent (the root's is -1) in the tree with most mutual information between neighbours given the
    class, where row i is toxic with probability q[i]."""
    n, k = votes.shape
    information = np.zeros((k, k))
    for weight in (1 - q, q):
        total = weight.sum() + 1e-9
        both = (votes * weight[:, None]).T @ votes / total
        one = np.diag(both).copy()
        for a, b, joint in ((1, 1, both), (1, 0, one[:, None] - both), (0, 1, one[None, :] - both), (0, 0, 1 - one[:, None] - one[None, :] + both)):
            apart = (one if a else 1 - one)[:, None] * (one if b else 1 - one)[None, :]
            joint = np.clip(joint, 1e-12, None)
            information += total / n * joint * np.log(joint / np.clip(apart, 1e-12, None))
    parent = np.full(k, -1)
    inside, best, link = np.zeros(k, bool), np.full(k, -1.0), np.full(k, -1)
    for _ in range(k):
        j = int(np.argmax(np.where(inside, -2.0, best)))
        inside[j], parent[j] = True, link[j]
        closer = information[j] > best
        best, link = np.where(closer, information[j], best), np.where(closer, j, link)
    return parent


def update(votes: np.ndarray, label: np.ndarray, q: np.ndarray, parent: np.ndarray, trust: float) -> np.ndarray:
    """A step of expectation-maximisation: from q, each voter's rate given the class and its parent's vote (with 0.2 of
    a vote in one more row, so that none is 0), and from the rates the new q. The label is right in trust of the rows."""
    above = np.where(parent >= 0, votes[:, parent], 0.0)
    log_odds = np.where(label == 1, 1.0, -1.0) * np.log(trust / (1 - trust))
    for sign, weight in ((-1, 1 - q), (1, q)):
        log_odds += sign * np.log((weight.sum() + 0.5) / (len(q) + 1))
        rate = [(weight @ (votes * part) + 0.2) / (weight @ part + 1) for part in (1 - above, above)]
        p = np.where(above == 1, rate[1], rate[0])
        log_odds += sign * np.where(votes == 1, np.log(p), np.log1p(-p)).sum(1)
    return 1 / (1 + np.exp(-np.clip(log_odds, -60, 60)))


def label_model(votes: np.ndarray, label: np.ndarray, trust: float = LABEL_TRUST, rounds: int = 30) -> np.ndarray:
    """Posterior probability of the toxic class for each row of votes (0/1), under a tree of voters given the class."""
    if votes.shape[1] < 3:
        return np.where(label == 1, LABEL_ALONE, 1 - LABEL_ALONE)
    v = votes.astype(np.float64)
    q = np.clip(v.sum(1) / CERTAIN, 0.02, 0.98)
    for step in range(rounds):
        if step in (0, 3):  # links are learned from the votes alone, then once from what they have shown
            parent = voter_tree(v, q)
        before, q = q, update(v, label, q, parent, trust)
        if step > 3 and np.abs(q - before).max() < 1e-6:
            break
    return q


def fit_linear(x: np.ndarray, q: np.ndarray, penalty: float = 2.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft labels, by Newton's method."""
    n = x.shape[1] + 1
    ridge = np.full(n, penalty)
    ridge[-1] = 1e-3
    w = np.zeros(n)
    for _ in range(rounds):
        h, gradient = np.diag(ridge), -ridge * w
        for a in range(0, len(x), BLOCK_ROWS):  # the rows are bytes; only a block's are doubles at a time
            part = np.ones((len(x[a : a + BLOCK_ROWS]), n))
            part[:, :-1] = x[a : a + BLOCK_ROWS]
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            h += (part * (p * (1 - p) + 1e-6)[:, None]).T @ part
            gradient += part.T @ (q[a : a + BLOCK_ROWS] - p)
        step = np.linalg.solve(h, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def clean_cut(z: np.ndarray, label: np.ndarray) -> float:
    """The log odds from which on texts are dropped, 0 (even odds) at most: of those that keep KEPT_CLEAN of the texts
    labelled clean the one where shares of toxic texts dropped and clean ones kept add up to most, of equals the highest."""
    toxic, clean = np.sort(z[label == 1]), np.sort(z[label == 0])
    cuts = np.append(np.unique(z[z < 0]), 0.0)
    kept = np.searchsorted(clean, cuts) / len(clean)
    both = np.where((kept >= KEPT_CLEAN) | (cuts == 0), kept + 1 - np.searchsorted(toxic, cuts) / len(toxic), -1)
    return float(cuts[np.flatnonzero(both == both.max())[-1]])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The classifier's features and weights. Without both kinds of labels there are no features, only a bias."""
    return fit_and_cut(docs, labels, most, id_col, text_col)[:2]


def fit_and_cut(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray, float]:
    """fit() with the log odds from which on a text is dropped; without both kinds of labels these are 0."""
    rows = stored(training_rows(docs, labels, most, id_col, text_col), "labelled")
    try:
        return fit_rows(rows)
    finally:
        discard(rows)


def fit_rows(rows: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """fit_and_cut() for rows (doc_id, text, toxic), which are read three times."""
    counted = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = counted.get(1, 0), counted.get(0, 0)
    if not n_pos or not n_neg:
        return [], np.array([0.0 if n_pos == n_neg else (4.0 if n_pos else -4.0)]), 0.0
    counts = stored(count_features(rows), "features")
    names, candidates = choose_features(counts, n_pos, n_neg), voter_candidates(counts, n_pos, n_neg)
    discard(counts)
    known = {x: i for i, x in enumerate(dict.fromkeys(names + candidates))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            doc, feature, _ = document_features(part["text"], known)
            at = np.searchsorted(doc, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["toxic"], lists], ["doc_id", "toxic", "has"])

    found = rows.mapInArrow(run, "doc_id long, toxic int, has array<int>").toPandas().sort_values(["doc_id", "toxic"], kind="stable")
    x = np.zeros((len(found), len(known)), np.uint8)
    for i, has in enumerate(found["has"]):
        x[i, has] = 1
    may = x[:, [known[c] for c in candidates]].astype(np.float32)
    label, x = found["toxic"].to_numpy(), x[:, : len(names)]
    weights = fit_linear(x, label_model(may[:, distinct_voters(may)], label))
    z = np.concatenate([x[a : a + BLOCK_ROWS] @ weights[:-1] + weights[-1] for a in range(0, len(x), BLOCK_ROWS)])
    return names, weights, clean_cut(z, label)


def score(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs; a null text counts as empty, an empty text gets the score of the bias."""
    names, weights = model
    known = {x: i for i, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            doc, feature, _ = document_features(part["text"], known)
            z = np.bincount(doc, weights[:-1][feature], part.num_rows) + weights[-1] if len(doc) else np.full(part.num_rows, weights[-1])
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    Labels (doc_id, toxic) teach only where crc32(doc_id as text) mod 5 is not 0; labels other than 0 and 1 and those
    of no document are left out, of repeated ones the largest counts. A null doc_id is not held out. Rows that repeat
    give repeated rows. Without both kinds of labels all scores are alike.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, fit(docs, labels, most)).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose texts stay below clean_cut(), with the columns of docs."""
    names, weights, cut = fit_and_cut(docs, labels)
    known = {x: i for i, x in enumerate(names)}

    def toxic(texts):
        import pandas as pd

        size = max(1, len(texts))
        out = np.zeros(len(texts), bool)
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(np.arange(size)[: len(texts)])], ["text", "i"])
        for part in slices(iter([batch])):
            doc, feature, _ = document_features(part["text"], known)
            z = np.bincount(doc, weights[:-1][feature], part.num_rows) + weights[-1] if len(doc) else np.full(part.num_rows, weights[-1])
            out[part["i"].to_numpy()] = z >= cut
        return pd.Series(out)

    return docs.filter(~F.pandas_udf(toxic, "boolean")("text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every row of documents, see toxicity(): a null text counts as empty, equal texts have equal scores."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
