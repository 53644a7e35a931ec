"""Language-model scores from a hidden Markov model over word classes.

Words are counted over the whole training part. The most frequent words are classes of their own, all others share
classes by their last bytes, and the end of a text is a class. A hidden Markov model over classes is trained by
Baum-Welch from a seeded random model: in every round each partition computes the expected counts of its whole texts,
the counts are summed by Spark in a tree of partial sums, the driver normalises them, until the likelihood of all
training texts settles. The score of a text is the exact likelihood of its whole sequence of classes by the scaled
forward recursion, times the probability of each word within its class.

Long sequences are split into segments whose K x K transfer matrices are computed side by side and then multiplied
in order, which equals the plain recursion. Training does the same in both directions, so that forward and backward
probabilities are carried over the edges of segments.

What is broadcast is bounded: the ``KNOWN`` most frequent words with their counts, and the model. Counts of all other
words stay in a table and are joined. No text is left out of a round or cut.

Cases: null and empty texts are one end token; texts are scored whole; repeated rows are scored each time and count
each time; null ids are in the held-out part; without training texts all words are unknown. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, written

STATES, SEGMENT = 6, 64
#: Baum-Welch ends when a round raises the log-likelihood by less than this share, after a few rounds at least.
SETTLED, LEAST_ROUNDS = 1e-4, 5
#: Words with a class of their own; words whose counts are broadcast; the longest word among them, in bytes.
OWN_CLASS, KNOWN, LONGEST = 60_000, 200_000, 64
SHAPES = 255
HELD, CHUNK, SLICE = 300_000, 200_000, 4096
#: Partial counts that are added up by one task.
FAN_IN = 16
END = b""


def tokens(text: str) -> list[bytes]:
    """Words of the text with A-Z in lower case, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def shape(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SHAPES


def _counted(batches):
    held: Counter = Counter()

    def out():
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()

    for batch in batches:
        for x in batch.column("text").to_pylist():
            held.update(tokens(x or ""))
            if len(held) > HELD:
                yield from out()
    yield from out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end of a text is the empty word."""
    pick = docs.select(F.col("text").cast("string").alias("text"))
    return pick.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    known: dict[bytes, int]  # word to its place in the next two
    classes: np.ndarray
    logs: np.ndarray  # log10(count + 0.1)
    mass: np.ndarray  # for each class: the counts of its words plus 0.1 for each
    total: float  # all counts plus 0.1 for each word and 0.1 for the unknown
    train_tokens: int

    @property
    def n_classes(self) -> int:
        return len(self.mass)

    def encode(self, text: str):
        """(classes, log10 of counts of the known words, how many these are, the other words)."""
        words = tokens(text)
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(at < 0)
        codes = np.zeros(len(words), "<u2")
        inside = at if not len(new) else at[at >= 0]
        other = [words[i] for i in new.tolist()]
        codes[at >= 0] = self.classes[inside]
        if other:
            codes[new] = [self.n_classes - SHAPES + shape(w) for w in other]
        return codes, float(self.logs[inside].sum()), len(inside), other


def vocabulary(counts: DataFrame) -> Vocabulary:
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = int(whole["n"] or 0), int(whole["v"] or 0)
    top = counts.filter(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
    words, ns = top["word"].to_pylist(), top["n"].to_numpy()
    by_shape = counts.groupBy((F.crc32(F.expr("substring(word, -2, 2)")) % SHAPES).alias("s")).agg((F.sum("n") + 0.1 * F.count("*")).alias("m"))
    shapes = np.full(SHAPES, 0.1 / SHAPES)
    for r in by_shape.collect():
        shapes[r["s"]] += r["m"]
    own = [(w, int(c)) for w, c in zip(words[:OWN_CLASS], ns[:OWN_CLASS])]
    for w, c in own:
        shapes[shape(w)] -= c + 0.1
    first = len(own)
    classes = np.array([i if i < first else first + shape(w) for i, w in enumerate(words)], "<u2")
    mass = np.concatenate([[c + 0.1 for _, c in own], np.maximum(shapes, 0.1 / SHAPES)])
    return Vocabulary({w: i for i, w in enumerate(words)}, classes, np.log10(ns + 0.1), mass, n + 0.1 * (v + 1), n)


@dataclass
class Hmm:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # classes x K: P(class | state)


def _windows(codes: list[np.ndarray], size: int = SEGMENT):
    """Windows of all sequences, long ones first: (padded windows x size, lengths, sequence, is first of it)."""
    n = np.array([len(x) for x in codes])
    per = -(-n // size)
    owner = np.repeat(np.arange(len(codes)), per)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(size, n[owner] - index * size)
    begin = (np.cumsum(n) - n)[owner] + index * size
    order = np.argsort(-length, kind="stable")
    at = begin[order, None] + np.arange(size)
    flat = np.concatenate(codes).astype(np.int32)
    return flat[np.minimum(at, len(flat) - 1)], length[order], owner[order], index[order]


def _emissions(model: Hmm, grid: np.ndarray, kind) -> list[np.ndarray]:
    """For each place in the windows the K x windows probabilities of the classes there."""
    emit = np.ascontiguousarray(model.emit.T, kind)
    return [emit.take(own, axis=1) for own in np.ascontiguousarray(grid.T)]


def _transfers(model: Hmm, seen: list[np.ndarray], n_at: list[int], first: np.ndarray):
    """K x K x windows: what carries forward probabilities (second axis: before the window, first: at its last token)
    over each window, scaled, and log10 of the scales. ``seen``: see ``_emissions``, whose precision is used."""
    k, kind = len(model.start), seen[0].dtype
    move = np.ascontiguousarray(model.move.T, kind)
    at = np.where(first, np.eye(k, dtype=kind)[:, :, None], move[:, :, None]) * seen[0][:, None, :]
    logs = np.zeros(len(first))
    live = at  # the windows that have not ended, side by side
    for t in range(1, len(seen)):
        n = n_at[t]
        if not n:
            break
        if n < live.shape[2]:
            at[:, :, n : live.shape[2]] = live[:, :, n:]
            live = np.ascontiguousarray(live[:, :, :n])
        live = (move @ live.reshape(k, -1)).reshape(k, k, n)
        live *= seen[t][:, None, :n]
        if t % 4 == 0:
            top = live.max(axis=(0, 1))
            live /= top
            logs[:n] += np.log10(top)
    at[:, :, : live.shape[2]] = live
    return at, logs


def _edges(model: Hmm, seen: list[np.ndarray], length: np.ndarray, owner: np.ndarray, index: np.ndarray):
    """K x windows: the scaled forward probabilities just before each window and the backward ones at its last token."""
    k, kind = len(model.start), seen[0].dtype
    before, behind = np.ones((k, len(owner)), kind), np.ones((k, len(owner)), kind)
    many = np.flatnonzero(np.bincount(owner)[owner] > 1)
    if not len(many):
        return before, behind
    own_length = length[many]
    n_at = [int((own_length > t).sum()) for t in range(len(seen))]
    at, _ = _transfers(model, [x[:, many] for x in seen], n_at, index[many] == 0)
    by = np.argsort(index[many], kind="stable")
    levels = np.split(by, np.cumsum(np.bincount(index[many]))[:-1])
    now = np.repeat(model.start.astype(kind)[:, None], owner.max() + 1, axis=1)
    for level in levels:
        own = owner[many[level]]
        before[:, many[level]] = now[:, own]
        step = (at[:, :, level] * now[None, :, own]).sum(axis=1)
        now[:, own] = step / step.sum(axis=0)
    now = np.ones((k, owner.max() + 1), kind)
    for level in levels[::-1]:
        own = owner[many[level]]
        behind[:, many[level]] = now[:, own]
        step = (at[:, :, level] * now[:, None, own]).sum(axis=0)
        now[:, own] = step / step.sum(axis=0)
    return before, behind


def expected(model: Hmm, codes: list[np.ndarray], n_classes: int):
    """Baum-Welch counts of whole sequences: (start K, moves K x K, emissions classes x K), and log10 P of all.

    In single precision, and again in double where probabilities are so small that it does not hold them.
    """
    for kind in (np.float32, np.float64):
        with np.errstate(all="ignore"):
            found = _expected(model, codes, n_classes, kind)
        if all(np.isfinite(x).all() for x in found):
            return found
    raise FloatingPointError("probabilities are too small for double precision")


def _expected(model: Hmm, codes: list[np.ndarray], n_classes: int, kind):
    """``expected`` in one precision. States are the first axis, so that all arithmetic runs along windows."""
    grid, length, owner, index = _windows(codes)
    size = grid.shape[1]
    n_at = [int((length > t).sum()) for t in range(size)]
    s, k = len(grid), len(model.start)
    seen = _emissions(model, grid, kind)
    move = model.move.astype(kind)
    onward = np.ascontiguousarray(move.T)
    before, behind = _edges(model, seen, length, owner, index)
    inner = index > 0
    alpha, scale = np.zeros((size, k, s), kind), np.ones((size, s), kind)
    for t in range(size):
        n = n_at[t]
        if not n:
            break
        a = onward @ alpha[t - 1, :, :n] if t else np.where(inner, onward @ before, model.start.astype(kind)[:, None])
        a *= seen[t][:, :n]
        np.sum(a, axis=0, out=scale[t, :n])
        np.divide(a, scale[t, :n], out=alpha[t, :, :n])
    # Scaled so that the probabilities of the states at a token sum to 1.
    last = alpha[length - 1, :, np.arange(s)].T
    beta = behind / (last * behind).sum(axis=0)
    moves = np.zeros((k, k))
    for t in range(size - 1, -1, -1):
        n = n_at[t]
        if not n:
            continue
        right = seen[t][:, :n] * beta[:, :n]
        right /= scale[t, :n]
        alpha[t, :, :n] *= beta[:, :n]
        if t:
            # The earlier token's forward probabilities; its own product with ``beta`` comes in the next step.
            moves += alpha[t - 1, :, :n] @ right.T
            beta[:, :n] = move @ right
        else:
            moves += before[:, inner] @ right[:, inner].T
    classes = np.ascontiguousarray(grid.T).ravel()  # places behind a window's end weigh nothing
    emissions = np.stack([np.bincount(classes, weights=alpha[:, i].ravel(), minlength=n_classes) for i in range(k)], axis=1)
    return alpha[0][:, ~inner].sum(axis=1), moves * model.move, emissions, float(np.log10(scale, dtype=float).sum())


def normalised(start, moves, emissions, prior: np.ndarray) -> Hmm:
    """Probabilities from counts, with a little of the classes' overall shares ``prior`` in every state."""
    start, moves = start + 1.0, moves + 1.0
    emit = (emissions + 50.0 * prior[:, None]) / (emissions.sum(axis=0) + 50.0)
    return Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emit)


def starting_point(prior: np.ndarray, states: int = STATES) -> Hmm:
    """A seeded random model around the classes' overall shares."""
    rng = np.random.default_rng(11)
    emit = prior[:, None] * rng.uniform(0.5, 1.5, (len(prior), states))
    move = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(move, 0.95)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def log_likelihoods(model: Hmm, codes: list[np.ndarray]) -> np.ndarray:
    """log10 P of each whole sequence."""
    grid, length, owner, index = _windows(codes)
    n_at = [int((length > t).sum()) for t in range(grid.shape[1])]
    at, logs = _transfers(model, _emissions(model, grid, np.float64), n_at, index == 0)
    out, now = np.zeros(len(codes)), np.repeat(model.start[:, None], len(codes), axis=1)
    by = np.argsort(index, kind="stable")
    for level in np.split(by, np.cumsum(np.bincount(index))[:-1]):
        own = owner[level]
        step = (at[:, :, level] * now[None, :, own]).sum(axis=1)
        top = step.sum(axis=0)
        now[:, own] = step / top
        out[own] += logs[level] + np.log10(top)
    return out


def _batched(codes: list[bytes]):
    """Lists of code arrays of about ``CHUNK`` tokens."""
    held, n = [], 0
    for x in codes:
        held.append(np.frombuffer(x, "<u2"))
        n += len(held[-1])
        if n >= CHUNK:
            yield held
            held, n = [], 0
    if held:
        yield held


def baum_welch_round(coded: DataFrame, model: Hmm, prior: np.ndarray) -> tuple[Hmm, float]:
    """One round over all rows of ``coded`` (codes): the new model, and log10 P of all rows by the old one."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    n_classes, k = model.emit.shape

    def run(batches):
        total = np.zeros((n_classes + 2 + k, k))
        for batch in batches:
            for codes in _batched(batch.column("codes").to_pylist()):
                start, moves, emissions, likely = expected(shared.value, codes, n_classes)
                total += np.concatenate([emissions, start[None], moves, np.full((1, k), likely)])
        cuts = range(0, len(total), SLICE)
        context = TaskContext.get()
        node = np.full(len(cuts), context.partitionId() if context else 0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array(node), pa.array([total[i : i + SLICE].tobytes() for i in cuts], pa.binary())], names=["slice", "node", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in rows["counts"].to_pylist())
        return pa.table({"slice": rows["slice"][:1], "node": rows["node"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    part = "slice int, node long, counts binary"
    width, sums = coded.rdd.getNumPartitions(), coded.select("codes").mapInArrow(run, part)
    while width > 1:
        width = -(-width // FAN_IN)
        sums = sums.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")).groupBy("slice", "node").applyInArrow(add, part)
    found = sums.toArrow().sort_by("slice")
    total = np.concatenate([np.frombuffer(x, "<f8").reshape(-1, k) for x in found["counts"].to_pylist()])
    shared.unpersist()
    return normalised(total[n_classes], total[n_classes + 1 : -1], total[:n_classes], prior), float(total[-1, 0])


def fit(coded: DataFrame, prior: np.ndarray) -> Hmm:
    """Baum-Welch over all rows of ``coded`` until the likelihood settles."""
    model, old, rounds = starting_point(prior), -np.inf, 0
    while True:
        model, likely = baum_welch_round(coded, model, prior)
        rounds += 1
        if rounds > LEAST_ROUNDS and likely - old <= SETTLED * abs(likely):
            return model
        old = likely


CODED = "row long, doc_id long, held_out boolean, n_tokens long, codes binary, base double, n_known long, others array<binary>"


def score_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 10) == 0).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    counts = written(word_counts(rows.filter("not held_out")), "words")
    vocab = vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocab)

    def code(batches):
        for batch in batches:
            found = [shared.value.encode(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([len(x[0]) for x in found], pa.int64()),
                    pa.array([x[0].tobytes() for x in found], pa.binary()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.int64()),
                    pa.array([x[3] for x in found], pa.list_(pa.binary())),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "codes", "base", "n_known", "others"],
            )

    coded = written(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(code, CODED), "coded")

    prior = vocab.mass / vocab.mass.sum()
    train = coded.filter("not held_out")
    model = fit(train, prior)
    both = spark.sparkContext.broadcast((model, np.log10(vocab.mass)))

    def forward(batches):
        for batch in batches:
            likely, within = [], []
            own = both.value[1].copy()
            for codes in _batched(batch.column("codes").to_pylist()):
                likely.append(log_likelihoods(both.value[0], codes))
                within += [-float(own[c].sum()) for c in codes]
            value = (np.concatenate(likely) if likely else np.zeros(0)) + np.array(within)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("row", "doc_id", "held_out", "n_tokens", "base", "n_known")] + [pa.array(value)],
                names=["row", "doc_id", "held_out", "n_tokens", "base", "n_known", "likely"],
            )

    scored = coded.drop("others").mapInArrow(forward, "row long, doc_id long, held_out boolean, n_tokens long, base double, n_known long, likely double")
    others = coded.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    met = others.join(counts, "word", "left")
    sums = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.1)).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
    )
    joined = scored.join(sums, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.train_tokens).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * float(np.log10(vocab.total))).alias("base_score"),
        (base + F.col("likely")).alias("score"),
    )
