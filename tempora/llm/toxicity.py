"""Toxicity by weak supervision.

Many voters look at a text: lexicons of insults, words mined from the labelled rows, and patterns such as direct address
or shouting. A generative label model with a latent class estimates by EM, from the votes on all training texts, labelled
or not, how often each voter fires on toxic and on other texts (its accuracies), and for every voter at most one other on
whose vote its own depends given the class (its correlations): the edges are the strongest tree of mutual information
given the class, and the chances of a vote are estimated for each vote of the other, so a voter that repeats another
adds nothing. Labels only mine words and give EM its start, which tells which of the classes is the toxic one; from there
on it sees the votes alone. The posteriors, not the labels, train a linear classifier over hashed words, and that classifier alone scores texts.

Voters are DataFrame operations. Votes are counted by Spark over all training texts, and only the counts of patterns, at
most two to the number of voters, reach the driver. The classifier's fit uses at most ``SAMPLE_ROWS`` labelled rows,
those with the smallest hashes of their ids; it runs in one task, as numbers of buckets and posteriors, and only the
coefficients that are not zero reach the driver. All texts are scored where they are, by sums of coefficients.

Cases: null and empty texts have no words and get the score of the intercept; texts are scored whole; repeated rows are
scored each time; labels that are null are not learned from; ids that are repeated in the labels count once; with no
labelled rows, or none that is toxic by any voter, every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, one_of_each, tidy, written

#: Labelled rows that the fit uses at most.
SAMPLE_ROWS = 20_000
FEATURES = 1 << 18
#: Penalties of the classifier's coefficients, on their sizes and half their squares, and the rounds of its fit at most.
L1, L2, FIT_ROUNDS = 1e-5, 1e-5, 300
#: Words mined from the labels, and the voters that they are dealt to.
MINED_WORDS, MINED_VOTERS = 240, 12
EM_ROUNDS = 100
#: Information of two voters about one another, in nats a text, with which they are tied.
LEAST_INFORMATION = 1e-6

# Words that insult.
LEXICONS = {
    "mind": ["idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool", "cretin", "halfwit", "dimwit"],
    "worth": ["worthless", "trash", "garbage", "loser", "losers", "useless", "failure", "nobody", "waste"],
    "contempt": ["pathetic", "disgusting", "clown", "scum", "vermin", "filth", "filthy", "ugly", "creep", "pig", "swine"],
    "crude": ["bastard", "bitch", "asshole", "shit", "fuck", "fucking", "crap", "dick", "slut", "whore", "bullshit"],
    "threat": ["kill", "die", "hate", "destroy", "hang", "shoot", "burn", "rape", "murder"],
    "german": ["dumm", "dummkopf", "arschloch", "scheiße", "versager", "abschaum", "blödmann", "trottel", "wertlos", "widerlich"],
    "french": ["imbécile", "salaud", "connard", "connasse", "merde", "stupide", "abruti", "minable", "dégoûtant", "ordure"],
    "spanish": ["imbécil", "estúpido", "estúpida", "basura", "asqueroso", "patético", "inútil", "cabrón", "mierda", "tonto"],
}
ADDRESS = r"\b(?:you|your|du|ihr|tu|vous|usted|eres|es|bist)(?:\s+(?:are|re|a|an|such|ein|eine|un|une|una|total|complete))*\s+(?:%s)\b"


def words_of(text: Column) -> Column:
    """Words of letters and digits, in lower case."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, words, toxic) of at most ``most`` labelled rows that may be learned from: of the rows of one id one."""
    picked = (
        labels.filter("toxic is not null and doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(crc_mod("doc_id", 5) != 0)
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The broadcast side has at most ``most`` pairs of numbers.
    return one_of_each(rows.join(F.broadcast(picked), "doc_id")).withColumn("words", words_of(F.col("text")))


def mined_words(rows: DataFrame, most: int = MINED_WORDS) -> list[str]:
    """Words whose share among toxic labels is surely more than twice that among the others."""
    whole = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count("*").alias("all")).first()
    lift = 2.0 * max(whole["bad"], 1) / max(whole["all"] - whole["bad"], 1)
    counted = (
        rows.select("toxic", F.explode(F.array_distinct("words")).alias("word"))
        .filter(F.length("word").between(3, 40))
        .groupBy("word")
        .agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
        .filter("bad >= 5")
    )
    low = F.col("bad") - 2 * F.sqrt("bad")
    ratio = low / (F.col("all") - F.col("bad") + 1)
    return [r["word"] for r in counted.filter(ratio > lift).orderBy((ratio * F.sqrt(low)).desc(), "word").limit(most).collect()]


def voters(mined: list[str]) -> dict[str, Column]:
    """Name to a Boolean column over (text, words)."""
    hits = lambda found: F.arrays_overlap("words", F.array(*[F.lit(x) for x in found]))
    out = {f"lexicon {k}": hits(v) for k, v in LEXICONS.items()}
    for i in range(MINED_VOTERS):  # dealt out, so that every voter knows words of all languages and strengths
        if own := mined[i::MINED_VOTERS]:
            out[f"mined {i}"] = hits(own)
    known = sorted({x for v in LEXICONS.values() for x in v})
    out["two words"] = F.size(F.array_intersect("words", F.array(*[F.lit(x) for x in known]))) >= 2
    out["address"] = F.lower("text").rlike(ADDRESS % "|".join(known))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    out["shouting"] = (letters >= 20) & (F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) > 0.7 * letters)
    out["marks"] = F.col("text").rlike(r"!{3,}|[!?]{4,}")
    return out


@dataclass
class LabelModel:
    """``rates``: P(fires | class), 2 x voters. ``parents``: the voter on whose vote each depends, or -1. ``chances``:
    P(fires | class, the parent's vote), 2 x 2 x voters. ``correlations``: of votes given the class, 2 x voters x voters."""

    names: list[str]
    prior: float
    rates: np.ndarray
    parents: list[int]
    chances: np.ndarray
    correlations: np.ndarray

    @property
    def bias(self) -> float:
        return float(np.log(self.prior / (1 - self.prior)))

    def evidence(self) -> np.ndarray:
        """Log-odds that each vote adds: the parent's vote x own vote x voters."""
        fires = np.log(self.chances[1] / self.chances[0])
        quiet = np.log((1 - self.chances[1]) / (1 - self.chances[0]))
        return np.stack([quiet, fires], axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        table, odds = self.evidence(), np.full(len(votes), self.bias)
        for j, k in enumerate(self.parents):
            odds += table[votes[:, k] if k >= 0 else 0, votes[:, j], j]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _dependence(votes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mutual information of every two voters given the class, in nats a text, and their correlations in each class."""
    total, n = weight.sum(), votes.shape[1]
    info, corr = np.zeros((n, n)), np.zeros((2, n, n))
    for y in (0, 1):
        size = weight[y].sum() + 1e-9
        one = (weight[y] @ votes) / size
        both = (votes * weight[y][:, None]).T @ votes / size
        cells = [(both, one[:, None] * one), (one[:, None] - both, one[:, None] * (1 - one)), (one - both, (1 - one)[:, None] * one), (1 - one[:, None] - one + both, (1 - one)[:, None] * (1 - one))]
        for p, q in cells:
            p = np.maximum(p, 0)
            info += size / total * np.where(p > 1e-12, p * np.log(np.maximum(p, 1e-12) / np.maximum(q, 1e-12)), 0)
        spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
        corr[y] = (both - one[:, None] * one) / np.outer(spread, spread)
    np.fill_diagonal(info, 0)
    return info, corr


def _strongest_tree(info: np.ndarray, least: float) -> list[int]:
    """Parents in a forest with the most information; edges with less than ``least`` are left out."""
    n = len(info)
    parents, best, come = [-1] * n, np.full(n, -1.0), [-1] * n
    left = set(range(n))
    while left:
        j = max(left, key=lambda x: (best[x], -x))
        left.remove(j)
        if best[j] >= least:
            parents[j] = come[j]
        for k in left:
            if info[j, k] > best[k]:
                best[k], come[k] = info[j, k], j
    return parents


def _estimated(names: list[str], votes: np.ndarray, weight: np.ndarray) -> LabelModel:
    """The model that fits votes best whose patterns have these weights in the two classes (2 x patterns)."""
    total, size = weight.sum(), weight.sum(axis=1)
    rates = (weight @ votes + 0.5) / (size[:, None] + 1.0)
    info, corr = _dependence(votes, weight)
    parents = _strongest_tree(info, max(10.0 / max(total, 1.0), LEAST_INFORMATION))
    chances = np.stack([rates, rates], axis=1)
    for j, k in enumerate(parents):
        if k < 0:
            continue
        for a in (0, 1):
            own = weight * (votes[:, k] == a)
            # Shrunk to the voter's rate in the class, so that rare votes of the parent say little.
            chances[:, a, j] = (own @ votes[:, j] + 2 * rates[:, j]) / (own.sum(axis=1) + 2)
    return LabelModel(names, float(np.clip(size[1] / max(total, 1.0), 1e-4, 0.5)), rates, parents, np.clip(chances, 1e-6, 1 - 1e-6), corr)


def fit_label_model(names: list[str], votes: np.ndarray, counts: np.ndarray, start: LabelModel | None = None, rounds: int = EM_ROUNDS) -> LabelModel:
    """EM over counted vote patterns. ``votes``: patterns x voters, 0 or 1.

    Without a model to start from, class 1 starts where voters fired that seldom fire, those that fire together sharing
    a say. The tree of dependences is drawn anew in every round from the posteriors of the round before.
    """
    votes, counts = votes.astype(np.int64), counts.astype(float)
    if start is None:
        share = (counts @ votes) / counts.sum()
        alike = _dependence(votes, np.stack([counts, 0 * counts]))[1][0] ** 2
        np.fill_diagonal(alike, 1.0)
        seldom = np.maximum(np.log((1 - share + 1e-3) / (share + 1e-3)), 0) / alike.sum(axis=1)
        post = 1 / (1 + np.exp(-(votes @ seldom - 2.0)))
    else:
        post = start.posterior(votes)
    for _ in range(rounds):
        model = _estimated(names, votes, np.stack([counts * (1 - post), counts * post]))
        post = model.posterior(votes)
    return model


def posterior(model: LabelModel, votes: dict[str, Column]) -> Column:
    odds, table = F.lit(model.bias), model.evidence()
    own = [votes[n] for n in model.names]
    for j, k in enumerate(model.parents):
        value = lambda a, j=j: F.when(own[j], F.lit(float(table[a, 1, j]))).otherwise(F.lit(float(table[a, 0, j])))
        odds = odds + (value(0) if k < 0 else F.when(own[k], value(1)).otherwise(value(0)))
    return 1 / (1 + F.exp(-odds))


def buckets(words: Column) -> Column:
    """The different buckets of words, each the number of a coefficient."""
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(FEATURES))))


@dataclass
class Classifier:
    """Logistic regression on which buckets a text has."""

    intercept: float
    coefficients: np.ndarray

    def probability(self, found: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` texts whose buckets are ``found``, each in the text ``row``."""
        odds = self.intercept + np.bincount(row, self.coefficients[found], n)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit_classifier(found: np.ndarray, row: np.ndarray, p: np.ndarray, features: int = FEATURES, rounds: int = FIT_ROUNDS) -> Classifier:
    """The classifier with the least mean logistic loss against posteriors ``p`` plus penalties.

    Accelerated proximal steps, started anew where they overshoot. A coefficient's step is as long as its curvature
    allows: at most a quarter of the mean, over the texts that have its bucket, of how many buckets they have.
    """
    n = len(p)
    size = np.bincount(row, minlength=n) + 1.0
    # The intercept is the last; it has no penalty.
    steep = np.append(np.bincount(found, size[row], features) + 1e-12, size.sum()) / (4 * n) + L2
    small = np.append(np.full(features, L1), 0.0) / steep
    shrink = np.append(np.full(features, L2), 0.0)
    share = float(np.clip(p.mean(), 1e-6, 1 - 1e-6))
    now = np.zeros(features + 1)
    now[-1] = np.log(share / (1 - share))
    ahead, pace = now, 1.0
    for _ in range(rounds):
        off = Classifier(ahead[-1], ahead[:-1]).probability(found, row, n) - p
        slope = np.append(np.bincount(found, off[row], features), off.sum()) / n + shrink * ahead
        new = ahead - slope / steep
        new = np.sign(new) * np.maximum(np.abs(new) - small, 0.0)
        step = new - now
        if np.abs(step).max() < 1e-4:
            now = new
            break
        if ((ahead - new) * steep) @ step > 0:
            pace = 1.0
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead, now, pace = new + (pace - 1) / faster * step, new, faster
    return Classifier(float(now[-1]), now[:-1])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The items of a column of lists, and the number of the row that each is in."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _fitted(rows: DataFrame) -> Classifier:
    """The classifier of stored (buckets, p), which are a bounded sample."""

    @tidy
    def run(batches):
        found, row, p, n = [], [], [], 0
        for batch in batches:
            own, at = _lists(batch.column("buckets"))
            found.append(own)
            row.append((at + n).astype(np.int32))
            p.append(batch.column("p").to_numpy(zero_copy_only=False))
            n += batch.num_rows
        if n:
            made = fit_classifier(np.concatenate(found), np.concatenate(row), np.concatenate(p))
            at = np.flatnonzero(made.coefficients)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(made.coefficients[at], made.intercept))], names=["bucket", "value"])

    got = rows.select("buckets", "p").coalesce(1).mapInArrow(run, "bucket int, value double").toArrow()
    at, value = got["bucket"].to_numpy(), got["value"].to_numpy()
    coefficients = np.zeros(FEATURES)
    coefficients[at[at >= 0]] = value[at >= 0]
    return Classifier(float(value[at < 0][0]), coefficients)


@dataclass
class ToxicityModel:
    label_model: LabelModel | None
    classifier: Classifier | None


def counted_votes(rows: DataFrame, votes: dict[str, Column], more: list[str] = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """(patterns x voters, counts) of the votes on all rows (text, words); columns of ``more`` follow the voters."""
    cast = {f"_v{i}": F.coalesce(c, F.lit(False)).cast("int") for i, c in enumerate(votes.values())}
    found = rows.select(*[c.alias(k) for k, c in cast.items()], *more).groupBy(*cast, *more).agg(F.count("*").alias("n")).collect()
    return np.array([r[:-1] for r in found], np.int64).reshape(-1, len(cast) + len(more)), np.array([r["n"] for r in found], np.int64)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    rows = written(labelled(docs, labels, sample_rows), "labelled")
    votes = {n: F.coalesce(v, F.lit(False)) for n, v in voters(mined_words(rows)).items()}
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    training = docs.filter(crc_mod("doc_id", 5) != 0).select(text).withColumn("words", words_of(F.col("text")))
    patterns, counts = counted_votes(training, votes)
    # Votes of the sample are cast once and stored: the posteriors need each of them many times.
    cast = {n: F.col(f"v{i}") for i, n in enumerate(votes)}
    rows = written(rows.select("toxic", buckets(F.col("words")).alias("buckets"), *[v.alias(f"v{i}") for i, v in enumerate(votes.values())]), "votes")
    known, n = counted_votes(rows, cast, ["toxic"])
    if not len(known) or not patterns.any():
        return ToxicityModel(None, None)
    # The labels tell EM which class is the toxic one by where it starts; from there on it sees votes alone.
    toxic = known[:, -1] == 1
    start = _estimated(list(votes), known[:, :-1], np.stack([n * ~toxic, n * toxic]).astype(float)) if toxic.any() else None
    model = fit_label_model(list(votes), patterns, counts, start)
    return ToxicityModel(model, _fitted(rows.select("buckets", posterior(model, cast).alias("p"))))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        buckets(words_of(F.col("text"))).alias("buckets"),
    )
    classifier = model.classifier

    @tidy
    def run(batches):
        for batch in batches:
            value = classifier.probability(*_lists(batch.column("buckets")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(value)], names=["doc_id", "held_out", "score"])

    if classifier is None:
        out = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
