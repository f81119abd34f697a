"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model that
estimates how accurate and how correlated they are, and a linear classifier trained on its
posterior labels."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import pick, slices, small_side, smallest

WORD = re.compile(r"\w+")

#: Seed words of the lexicon voters, a start that mined lexicons extend.
INSULTS = ["idiot", "moron", "stupid", "loser", "clown", "fool", "dumb", "imbecile", "idiota", "estúpido", "imbécil", "imbécile",
           "stupide", "crétin", "abruti", "dumm", "trottel", "vollidiot", "tonto"]
CONTEMPT = ["pathetic", "worthless", "disgusting", "useless", "ridiculous", "hateful", "widerlich", "erbärmlich", "wertlos",
            "pathétique", "dégoûtant", "minable", "patético", "asqueroso", "inútil"]
SLURS = ["scum", "trash", "garbage", "vermin", "filth", "pig", "rat", "abschaum", "müll", "ordure", "racaille", "escoria", "basura"]
LEXICONS = [INSULTS, CONTEMPT, SLURS]

#: Pattern voters: abuse of a reader, masked words, shouting, runs of marks.
ADDRESS = {"you", "u", "du", "tu", "vous", "usted"}
PATTERNS = [re.compile(p) for p in (
    r"(?i)\b(?:you|u|du|tu|vous|usted)\s+(?:are|bist|es|êtes|eres)\s+(?:an?|ein|une?|una?)\b",
    r"(?i)[a-z]\*{2,}", r"[A-Z]{5,}\b(?:\W+[A-Z]{4,}\b){2}", r"[!?]{3}")]
#: Mined lexicons: word starts or whole words, lift from and below, and how many voters share them.
MINED = [(False, 40.0, float("inf"), 3), (False, 0.0, 40.0, 1), (True, 25.0, float("inf"), 2), (True, 0.0, 25.0, 1)]
#: Log-odds of a toxic row (one in ten) where no row is left to learn from.
PRIOR = -2.2


@dataclass(frozen=True)
class Weak:
    """``labelled`` and ``train`` bound the rows that lexicons are mined from and that the
    classifier is fitted to, drawn by a hash of doc_id; ``features`` bounds its vocabulary.
    All else covers all rows. A feature is mined when ``support`` toxic rows hold it."""

    labelled: int = 200_000
    train: int = 40_000
    features: int = 6_000
    lexicon: int = 1_500
    support: int = 4
    lift: float = 6.0
    edge: float = 0.02


def features(text: str | None) -> set[str]:
    """Words, and word starts of four and five letters in a space of their own."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {f"{w[:4]}-" for w in words if len(w) > 4} | {f"{w[:5]}-" for w in words if len(w) > 5}


def mined_features(rows: DataFrame, p: Weak) -> list[tuple[str, float, float]]:
    """(feature, lift, score), the most telling first, from labelled (toxic, text)."""
    def run(batches):
        for batch in slices(batches, "text"):
            counts: dict[str, list[int]] = {}
            toxic = batch.column("toxic").to_pylist()
            for label, text in zip(toxic, batch.column("text").to_pylist()):
                for f in features(text):
                    counts.setdefault(f, [0, 0])[label] += 1
            both = np.array(list(counts.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(both[:, 1]), pa.array(both[:, 0])], names=["feature", "bad", "good"])

    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    bad, good = max(n.get(1, 0), 1), max(n.get(0, 0), 1)
    counts = rows.mapInArrow(run, "feature string, bad long, good long").groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= p.support)
    lift = (F.col("bad") / bad) / ((F.col("good") + 1) / good)
    ranked = counts.withColumn("lift", lift).withColumn("score", F.col("bad") * F.log("lift")).where("lift > 1.5")
    return [tuple(r) for r in ranked.select("feature", "lift", "score").orderBy(F.desc("score"), "feature").limit(p.features).collect()]


class Voters:
    """Bit k of a document's pattern says that voter k fires."""

    def __init__(self, mined: list[tuple[str, float, float]], p: Weak) -> None:
        self.of: dict[str, int] = {w: 1 << k for k, words in enumerate(LEXICONS) for w in words}
        telling = [(f, lift) for f, lift, _ in mined if lift >= p.lift][:p.lexicon]
        at = len(LEXICONS)
        for starts, low, high, voters in MINED:
            part = [f for f, lift in telling if f.endswith("-") == starts and low <= lift < high]
            for rank, f in enumerate(part):
                self.of[f] = self.of.get(f, 0) | 1 << (at + rank % voters)
            at += voters
        self.base = at
        self.count = self.base + len(PATTERNS)

    def pattern(self, found: set[str], text: str) -> int:
        bits = 0
        for f in found & self.of.keys():
            bits |= self.of[f]
        # The first test of each line is a cheap sign that the pattern can match at all.
        likely = (not ADDRESS.isdisjoint(found), "**" in text, True, "!!" in text or "??" in text or "!?" in text or "?!" in text)
        for k, pattern in enumerate(PATTERNS):
            if likely[k] and pattern.search(text):
                bits |= 1 << (self.base + k)
        return bits


class LabelModel:
    """P(y) * product of P(vote | y, vote of its parent): voters form a forest, in which the
    most correlated pairs given y are joined. Fitted by expectation-maximisation to the
    number of documents per pattern; no label is used."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, voters: int, edge: float) -> None:
        self.votes = (patterns[:, None] >> np.arange(voters)) & 1
        self.counts = counts.astype(float)
        self.parent = np.full(voters, -1)
        fired = self.votes.sum(axis=1)
        self.posterior = np.where(fired == 0, 0.02, np.where(fired == 1, 0.4, 0.95))
        self._fit()
        self.correlations = self._correlations()
        self._forest(edge)
        self._fit()
        self.accuracies = self._accuracies()

    def _fit(self, rounds: int = 100) -> None:
        for _ in range(rounds):
            on, off = self.counts * self.posterior, self.counts * (1 - self.posterior)
            log = [np.full(len(self.counts), np.log((w.sum() + 1) / (self.counts.sum() + 2))) for w in (off, on)]
            for k in range(self.votes.shape[1]):
                above = self.votes[:, self.parent[k]] if self.parent[k] >= 0 else np.zeros(len(self.counts), int)
                for y, w in enumerate((off, on)):
                    for state in (0, 1):
                        here = above == state
                        yes, all_ = (w * here * self.votes[:, k]).sum(), (w * here).sum()
                        rate = (yes + 0.01) / (all_ + 0.02) if all_ else 0.5
                        # A voter for toxicity is never taken as a sign against it.
                        log[y] += np.where(here, np.where(self.votes[:, k] == 1, np.log(rate), np.log1p(-rate)), 0)
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
            done = np.abs(new - self.posterior).max(initial=0) < 1e-6
            self.posterior = new
            if done:
                break

    def _correlations(self) -> np.ndarray:
        """Correlation of each two voters within a class, the larger of both classes."""
        out = np.zeros((self.votes.shape[1],) * 2)
        for w in (self.counts * self.posterior, self.counts * (1 - self.posterior)):
            if w.sum() > 0:
                centred = self.votes - (w @ self.votes) / w.sum()
                cov = (centred * w[:, None]).T @ centred / w.sum()
                sd = np.sqrt(np.diag(cov)) + 1e-9
                out = np.maximum(out, np.abs(cov / np.outer(sd, sd)))
        np.fill_diagonal(out, 0)
        return out

    def _forest(self, edge: float) -> None:
        """Maximum spanning forest over correlations above ``edge``; a voter has one parent."""
        n, tree = len(self.parent), list(range(len(self.parent)))
        links: list[list[int]] = [[] for _ in range(n)]
        for c, a, b in sorted(((self.correlations[a, b], a, b) for a in range(n) for b in range(a)), reverse=True):
            if c > edge and tree[a] != tree[b]:
                links[a].append(b)
                links[b].append(a)
                tree = [tree[a] if t == tree[b] else t for t in tree]
        seen: set[int] = set()
        for root in range(n):
            stack = [(root, -1)]
            while stack:
                k, up = stack.pop()
                if k not in seen:
                    seen.add(k)
                    self.parent[k] = up
                    stack += [(j, k) for j in links[k]]

    def _accuracies(self) -> np.ndarray:
        """P(vote = class) of each voter under the posterior."""
        right = self.posterior[:, None] * self.votes + (1 - self.posterior[:, None]) * (1 - self.votes)
        return (self.counts[:, None] * right).sum(axis=0) / max(self.counts.sum(), 1)


def fit_linear(rows: np.ndarray, columns: np.ndarray, n: int, width: int, target: np.ndarray, length: np.ndarray,
               l2: float = 0.5, steps: int = 400) -> np.ndarray:
    """Logistic regression on binary features, log length and a constant; the last two weights
    belong to these. Soft targets. Adam on the whole sample."""
    w, m, v = np.zeros(width + 2), np.zeros(width + 2), np.zeros(width + 2)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[columns], minlength=n) + w[-2] * length + w[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        g = np.concatenate([np.bincount(columns, weights=e[rows], minlength=width) + l2 * w[:width], [(e * length).sum(), e.sum()]]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def calibration(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) of the logistic curve of a * z + b that fits the labels; (1, 0) without both classes."""
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return 1.0, 0.0
    x = np.stack([z, np.ones(len(z))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-3 * (w - [1.0, 0.0])), -2, 2)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def vote_patterns(docs: DataFrame, voters: Voters) -> DataFrame:
    """(pattern) of every text."""
    def run(batches):
        for batch in slices(batches, "text"):
            out = [voters.pattern(features(t), t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["pattern"])

    return docs.select("text").mapInArrow(run, "pattern int")


def training_rows(docs: DataFrame, voters: Voters, index: dict[str, int]) -> DataFrame:
    """(toxic, pattern, size, columns) of (toxic, text)."""
    def run(batches):
        for batch in slices(batches, "text"):
            patterns, sizes, columns = [], [], []
            for text in batch.column("text").to_pylist():
                found = features(text)
                patterns.append(voters.pattern(found, text or ""))
                sizes.append(len(found))
                columns.append([index[f] for f in found & index.keys()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(patterns, pa.int32()), pa.array(sizes, pa.int32()), pa.array(columns, pa.list_(pa.int32()))],
                names=["toxic", "pattern", "size", "columns"])

    return docs.select("toxic", "text").mapInArrow(run, "toxic int, pattern int, size int, columns array<int>")


def scored(docs: DataFrame, weights: dict[str, float], per_length: float, constant: float, a: float, b: float) -> DataFrame:
    """(doc_id, score) of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # as many entries as the vocabulary bound

    def run(batches):
        known = shared.value
        for batch in slices(batches, "text"):
            margins = []
            for text in batch.column("text").to_pylist():
                found = features(text)
                margins.append(sum(known[f] for f in found & known.keys()) + per_length * np.log1p(len(found)) + constant)
            z = np.clip(a * np.array(margins, float) + b, -50, 50)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
             params: Weak = Weak()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    held_out: crc32 of doc_id as text is divisible by 5; labels of such rows are never read.
    Of the others, labelled rows give the mined lexicons and the calibration. The label
    model is fitted to the votes over all documents, the classifier to its posterior labels
    of rows that are not held out. Scores depend on the text alone. predicted is 1 from 0.5 on.

    Null and empty texts get the score of a text without words. A null doc_id is not held
    out and not labelled. Labels that repeat a doc_id count as toxic if one of them is; null
    labels are ignored. Without labels only the seed voters work. Where
    no row is left to learn from, all rows get the same score, under 0.5. Other columns are
    ignored. An empty table gives an empty result.
    """
    p = params
    spark = docs.sparkSession
    base = pick(docs, doc_id=doc_id, text=text)
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held_out = F.coalesce(number % 5 == 0, F.lit(False))
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("at", F.xxhash64("doc_id", F.lit(3)))
    known = cut_lineage(smallest(known, "at", p.labelled).select("doc_id", "toxic"), "known")
    labelled = cut_lineage(base.join(small_side(known, p.labelled), "doc_id").select("doc_id", "toxic", "text"), "labelled")
    mined = mined_features(labelled.select("toxic", "text"), p)
    voters = Voters(mined, p)
    counts = vote_patterns(base, voters).groupBy("pattern").count().orderBy("pattern").toPandas()  # 2 ** voters rows at most
    model = LabelModel(counts["pattern"].to_numpy(np.int64), counts["count"].to_numpy(), voters.count, p.edge)
    posterior = dict(zip(counts["pattern"].tolist(), model.posterior.tolist()))

    vocabulary = sorted({f for f, _, _ in mined} | voters.of.keys())
    index = {f: k for k, f in enumerate(vocabulary)}
    total = max(int(counts["count"].sum()), 1)
    share = min(1.0, p.train / total)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))
    unlabelled = base.where(~held_out & F.coalesce(drawn, F.lit(False))).select(F.lit(None).cast("int").alias("toxic"), "text")
    share_labelled = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, p.train / max(labelled.count(), 1)) * (1 << 30))
    both = unlabelled.union(labelled.where(share_labelled).select("toxic", "text"))
    # About 2 * p.train rows of a few numbers each.
    sample = training_rows(both, voters, index).toArrow()
    sizes = np.log1p(sample["size"].to_numpy())
    lists = sample["columns"].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.int32()))
    columns = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(sizes)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    target = np.array([posterior.get(x, 0.0) for x in sample["pattern"].to_pylist()])
    if not len(sizes):
        # Nothing to learn from: every row gets a score well under the threshold.
        return scored(base, {}, 0.0, PRIOR, 1.0, 0.0).select(
            "doc_id", held_out.alias("held_out"), "score", F.lit(0).alias("predicted"))
    w = fit_linear(rows, columns, len(sizes), len(vocabulary), target, sizes)
    z = np.bincount(rows, weights=w[columns], minlength=len(sizes)) + w[-2] * sizes + w[-1]
    toxic = sample["toxic"].to_numpy(zero_copy_only=False)
    has = ~np.isnan(toxic.astype(float))
    a, b = calibration(z[has], toxic[has].astype(float))
    out = scored(base, {f: float(w[k]) for f, k in index.items() if w[k]}, float(w[-2]), float(w[-1]), a, b)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
