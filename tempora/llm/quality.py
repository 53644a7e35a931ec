"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded by fixed measures of its words and
characters, standardised and sent through one learned layer. Gated attention gives each passage a weight,

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) ),   z = sum_k a_k h_k,   score = sigmoid(c . z + d)

and the weights V, U, w are learned from the labels of whole documents only. The attended passages can be told from the
result of ``attention``.

The fit uses at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hashes of their ids. Spark encodes their
passages; the encoded bags, never texts, reach the driver. Scoring reads each row once and shuffles nothing.

Cases: a null or empty text is one passage without words; texts are scored whole, whatever their length; repeated rows
are scored each time; null labels are not learned from, repeated ids in the labels count once; with no labels every
score is 0.5. Columns other than the ones named are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, one_of_each, texts, tidy

PASSAGE_WORDS = 100
SAMPLE_ROWS = 8_000
#: Passages of one labelled text that the fit uses; scores use all.
LEARNED_PASSAGES = 1_000
HIDDEN, GATE = 12, 8
STEPS, RATE, DECAY, SEED = 200, 0.03, 1e-3, 17
#: Documents whose score is below this are rejected.
LEAST = 0.7

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_STOPS = b".,;:'\"?()-"
_SIGNS = b"#$%&*@<>{}[]\\/~^_=+`"
_HIGH = bytes(range(128, 256))
_KINDS = (_UPPER, _LOWER, _DIGITS, _STOPS, _SIGNS, b"!", b"|", _HIGH)
#: Measures of a passage: shares of the kinds above; mean length of words; shares of different words, word pairs and
#: of the most frequent word; words that end a sentence, begin with a capital, or are short; fill of the passage.
N_MEASURES = len(_KINDS) + 8


def encode(text: str) -> np.ndarray:
    """passages x measures."""
    words = text.split()
    out = []
    for at in range(0, max(len(words), 1), PASSAGE_WORDS):
        own = words[at : at + PASSAGE_WORDS]
        n = len(own)
        if not n:
            out.append([0.0] * N_MEASURES)
            continue
        raw = "".join(own).encode("utf-8", "surrogatepass")
        size = len(raw)
        shares = [(size - len(raw.translate(None, x))) / size for x in _KINDS]
        folded = [w.lower() for w in own]
        pairs = set(zip(folded, folded[1:]))
        most = Counter(folded).most_common(1)[0][1]
        out.append(
            shares
            + [
                size / n / 10,
                len(set(folded)) / n,
                len(pairs) / max(n - 1, 1),
                most / n,
                sum([w[-1] in ".!?" for w in own]) / n,
                sum([w[0].isupper() for w in own]) / n,
                sum([len(w) <= 3 for w in own]) / n,
                n / PASSAGE_WORDS,
            ]
        )
    return np.array(out, np.float32)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


@dataclass
class BagModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        counts = np.diff(np.append(starts, len(x)))
        owner = np.repeat(np.arange(len(starts)), counts)
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a = e / _sums(e, starts)[owner]
        z = _sums(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "owner": owner}

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores and, for each bag, the attention on its passages."""
        starts = np.cumsum([0, *[len(x) for x in bags[:-1]]])
        out = self.forward(self.standard(np.concatenate(bags)), starts)
        return out["y"], np.split(out["a"], starts[1:])


def gradients(model: BagModel, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy of the bags' labels; ``x`` is standardised."""
    p = model.weights
    f = model.forward(x, starts)
    owner, a, h, t, g = f["owner"], f["a"], f["h"], f["t"], f["g"]
    dy = (f["y"] - labels) / len(labels)
    grad = {"c": f["z"].T @ dy, "d": dy.sum()}
    dz = dy[:, None] * p["c"]
    dh = a[:, None] * dz[owner]
    da = (h * dz[owner]).sum(axis=1)
    de = a * (da - _sums(a * da, starts)[owner])
    grad["w"] = (t * g).T @ de
    dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
    grad["V"], grad["U"] = h.T @ dt, h.T @ dg
    dh += dt @ p["V"].T + dg @ p["U"].T
    dpre = dh * (1 - h * h)
    grad["W"], grad["b"] = x.T @ dpre, dpre.sum(axis=0)
    return grad


def fit(bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> BagModel:
    """Full-batch Adam on the cross-entropy of the bags' labels."""
    x = np.concatenate(bags).astype(np.float64)
    starts = np.cumsum([0, *[len(b) for b in bags[:-1]]])
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"W": draw(d, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN)}
    rate = np.clip(labels.mean(), 0.01, 0.99)
    p["d"] = np.array(np.log(rate / (1 - rate)))
    model = BagModel(x.mean(axis=0), x.std(axis=0) + 1e-3, p)
    x = model.standard(x)
    first, second = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}
    for step in range(1, steps + 1):
        grad = gradients(model, x, starts, labels)
        for k in p:
            own = grad[k] + (DECAY / len(labels) ** 0.5) * p[k] * (k not in "bd")
            first[k] = 0.9 * first[k] + 0.1 * own
            second[k] = 0.999 * second[k] + 0.001 * own * own
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        model.weights = p
    return model


def _thinned(bag: np.ndarray, most: int = LEARNED_PASSAGES) -> np.ndarray:
    """At most ``most`` passages of a bag, evenly spaced."""
    return bag if len(bag) <= most else bag[np.linspace(0, len(bag) - 1, most).astype(int)]


def _encoded(batches):
    for batch in batches:
        found = [_thinned(encode(x)).tobytes() for x in texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], names=["doc_id", "quality", "bag"]
        )


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> BagModel | None:
    picked = (
        labels.filter("quality is not null and doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(crc_mod("doc_id", 4) != 2)
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # The broadcast side has at most ``sample_rows`` pairs of numbers.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    found = one_of_each(rows).mapInArrow(_encoded, "doc_id long, quality int, bag binary").orderBy("doc_id").toArrow()
    if found.num_rows == 0:
        return None
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_MEASURES) for x in found["bag"].to_pylist()]
    return fit(bags, found["quality"].to_numpy().astype(np.float64))


def _scores(model: BagModel | None, found: list[str]) -> np.ndarray:
    if model is None:
        return np.full(len(found), 0.5)
    out = [model.score([encode(x) for x in found[i : i + 500]])[0] for i in range(0, len(found), 500)]
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: BagModel | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        for batch in batches:
            y = _scores(shared.value, texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(y, pa.float64()), pa.array((y >= LEAST).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    pick = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return pick.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def attention(docs: DataFrame, model: BagModel) -> DataFrame:
    """(doc_id, passage, first_word, weight): how much each passage of every row counts for its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                (weights,) = shared.value.score([encode(x)])[1]
                n = len(weights)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(range(0, n * PASSAGE_WORDS, PASSAGE_WORDS), pa.int64()), pa.array(weights, pa.float64())],
                    names=["doc_id", "passage", "first_word", "weight"],
                )

    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pick.mapInArrow(run, "doc_id long, passage int, first_word long, weight double")


def keep_good(docs: DataFrame, model: BagModel | None, least: float = LEAST) -> DataFrame:
    """Rows that score at least ``least``, with all their columns; everything stays if nothing could be learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        for batch in batches:
            if shared.value is None:
                yield batch
            else:
                yield batch.filter(pa.array(_scores(shared.value, texts(batch)) >= least))

    return docs.mapInArrow(run, docs.schema)
