"""Language identification with language-bitmask n-gram filters.

Character trigrams (words in lower case, padded by one blank) are counted for each language over all training texts.
A trigram belongs to every language where it is frequent and not far rarer than in the language that has it most.
One Bloom filter for each language is filled with its trigrams; the filters are bit-sliced: word ``p`` of the table has
bit ``l`` set if position ``p`` is set in language ``l``'s filter, so one AND over the probed words gives all languages
that contain a trigram. The trigrams of a text are looked up, bits are counted for each language, the counts are
corrected for the filter's share of false positives, and the language with the largest count wins.

The filter is bounded: a trigram must make up ``MIN_SHARE`` of a language's trigrams, so a language has at most
``1 / MIN_SHARE`` of them. Counting covers every training row and is combined before the shuffle.

Cases: texts that are null or have no letter get ``und`` with score 0; so does every text if nothing can be learned.
Ties go to the language that sorts first. Texts are processed whole, long ones in pieces cut between words. Repeated rows
count each time. An empty table gives an empty result. Columns other than the ones named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, in_chunks, texts, tidy

#: Share of a language's trigrams that one needs to belong to it, and its least ratio to the language with most.
MIN_SHARE, MIN_RATIO = 1e-5, 0.05
#: Positions of the filter for each trigram of the largest language, and probes.
BITS_A_GRAM, PROBES = 12, 4
#: Characters looked at together, and different trigrams that a task counts before it hands them on.
CHUNK, HELD = 400_000, 400_000
UNKNOWN = "und"

_LETTER = None


def _letter_table() -> np.ndarray:
    """For each code point: whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def grams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the texts, each packed into 63 bits, and for each text the place where its trigrams begin.

    A run of other characters than letters counts as one blank. A trigram has a letter in its middle.
    """
    joined = "\n" + "\n".join(x.lower() for x in found) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    table = _letter_table()
    letter = table[points]
    points = np.where(letter, points, 32)
    key = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    middle = letter[1:-1]
    stops = np.cumsum([len(x.lower()) + 1 for x in found])
    count = np.concatenate([[0], np.cumsum(middle)])
    return key[middle], count[np.concatenate([[0], np.minimum(stops, len(middle))])]


def pieces(found: list[str], most: int = CHUNK):
    """(text number, piece): long texts in pieces, cut between words where there are any."""
    for i, x in enumerate(found):
        while len(x) > most:
            at = max(x.rfind(" ", 0, most), x.rfind("\n", 0, most))
            at = at + 1 if at > 0 else most
            yield i, x[:at]
            x = x[at:]
        yield i, x


def _counts(batches):
    held: dict[str, pd.Series] = {}

    def out():
        for lang, series in held.items():
            n = len(series)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array(series.index.to_numpy(), pa.int64()), pa.array(series.to_numpy(), pa.int64())],
                names=["lang", "gram", "n"],
            )
        held.clear()

    for batch in batches:
        langs, found = batch.column("lang").to_pylist(), texts(batch)
        by: dict[str, list[str]] = {}
        for lang, x in zip(langs, found):
            by.setdefault(lang, []).append(x)
        for lang, own in by.items():
            parts = [x for _, x in pieces(own)]
            for a, b in in_chunks([len(x) for x in parts], CHUNK):
                keys, _ = grams(parts[a:b])
                counted = pd.Series(keys).value_counts(sort=False)
                held[lang] = held[lang].add(counted, fill_value=0).astype("int64") if lang in held else counted
        if sum(map(len, held.values())) > HELD:
            yield from out()
    yield from out()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the rows with a language."""
    pick = docs.filter("lang is not null").select("lang", F.col("text").cast("string").alias("text"))
    return pick.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filters. ``table[p]`` has a bit for each language; 64 languages to a word of a row."""

    langs: list[str]
    table: np.ndarray  # positions x words, uint64
    false_rate: np.ndarray  # for each language: the share of absent trigrams that it is said to contain

    def masks(self, keys: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.table))
        h = keys.astype(np.uint64)
        out = None
        for k in range(PROBES):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            row = self.table[((h >> np.uint64(20)) % size).astype(np.int64)]
            out = row if out is None else out & row
        return out

    def predict(self, found: list[str]) -> tuple[list[str], list[float]]:
        counts, total = np.zeros((len(found), len(self.langs))), np.zeros(len(found))
        parts = list(pieces(found))
        for a, b in in_chunks([len(x) for _, x in parts], CHUNK):
            keys, starts = grams([x for _, x in parts[a:b]])
            if not len(keys):
                continue
            mask = self.masks(keys)
            owner = np.array([i for i, _ in parts[a:b]])
            np.add.at(total, owner, np.diff(starts))
            for i in range(len(self.langs)):
                bits = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                upto = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
                np.add.at(counts[:, i], owner, upto[starts[1:]] - upto[starts[:-1]])
        n = np.maximum(total, 1)[:, None]
        true = np.clip((counts / n - self.false_rate) / (1 - self.false_rate), 0, 1)
        if not self.langs:
            return [UNKNOWN] * len(found), [0.0] * len(found)
        best = true.argmax(axis=1)
        score = true[np.arange(len(found)), best]
        known = total > 0
        return [self.langs[j] if k else UNKNOWN for j, k in zip(best, known)], np.where(known, score, 0.0).tolist()


def build_filter(langs: list[str], keys: np.ndarray, members: np.ndarray) -> LanguageFilter:
    """``members[i, l]``: whether trigram ``keys[i]`` belongs to language ``l``."""
    words = max(1, -(-len(langs) // 64))
    size = max(1024, BITS_A_GRAM * int(members.sum(axis=0).max(initial=0)))
    out = LanguageFilter(langs, np.zeros((size, words), np.uint64), np.zeros(len(langs)))
    slices = np.zeros((len(keys), words), np.uint64)
    for i in range(len(langs)):
        slices[:, i // 64] |= members[:, i].astype(np.uint64) << np.uint64(i % 64)
    h = keys.astype(np.uint64)
    for k in range(PROBES):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        at = ((h >> np.uint64(20)) % np.uint64(size)).astype(np.int64)
        for w in range(words):
            np.bitwise_or.at(out.table[:, w], at, slices[:, w])
    for i in range(len(langs)):
        fill = ((out.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
        out.false_rate[i] = fill**PROBES
    return out


def learn(docs: DataFrame) -> LanguageFilter:
    """The filter from all rows of ``docs`` with a language. At most ``1 / MIN_SHARE`` trigrams a language are collected."""
    counted = gram_counts(docs).persist()
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counted.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("p"))
    kept = share.filter(F.col("p") >= MIN_SHARE).toPandas()
    counted.unpersist()
    langs = sorted(kept["lang"].unique())
    wide = kept.pivot(index="gram", columns="lang", values="p").fillna(0.0) if len(kept) else pd.DataFrame()
    if not langs:
        return build_filter([], np.zeros(0, np.int64), np.zeros((0, 0), bool))
    p = wide[langs].to_numpy()
    members = (p >= MIN_SHARE) & (p >= MIN_RATIO * p.max(axis=1, keepdims=True))
    return build_filter(langs, wide.index.to_numpy(np.int64), members)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        for batch in batches:
            langs, score = shared.value.predict(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    pick = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return pick.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(crc_mod("doc_id", 4) != 2)


def keep_identified(docs: DataFrame, model: LanguageFilter, least: float = 0.2) -> DataFrame:
    """Rows whose text is in a learned language with at least this score; all columns stay, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        for batch in batches:
            langs, score = shared.value.predict(texts(batch))
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
