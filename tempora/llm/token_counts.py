"""Token counts by rank-synchronous merging of arrays.

The pre-tokens of a batch lie end to end in one ragged numpy array of symbols, beside it the rank of every pair of
neighbours. In each round every sequence applies its own lowest-ranked pair, everywhere it stands, all sequences at
once; sequences without a pair leave the array, and the symbols that have survived are their tokens.

That gives what merging one pair at a time gives, if a merge's result can only take part in later merges. A file in
which it could take part in earlier ones is refused, and so is one of another kind than plain byte-level BPE.

Texts are split as the tokenizers library splits them by default: strings of added tokens are one token each, the rest
is taken apart by the usual pattern, or by the library's own splitter where a text has letters that the pattern's
module may know otherwise. Pre-tokens repeat, so a worker counts each of them once, within bounds.

Cases: null and empty texts have no tokens; very long texts are split where no pre-token can cross, and counted whole;
a pre-token of any length is one sequence; repeated rows and ids give repeated rows; null ids stay null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .common import in_chunks, texts, tidy

#: Tokens above which a text is marked.
LIMIT = 512
#: Pre-tokens whose counts a task keeps, and the characters of the longest of them.
CACHE, KEPT = 500_000, 64
#: Bytes that are merged at once, and characters of a text that are split at once.
MERGED, STRETCH = 1 << 20, 1 << 20

# Fixed value: how byte-level BPE files of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters below the first that versions of Unicode disagree on.
_SETTLED = 0x558
#: No pre-token goes past a single space between two characters that are none.
_GAP = regex.compile(r"(?<=\S) (?=\S)")
_NONE = np.iinfo(np.int32).max


def _stretches(text: str, size: int) -> Iterator[str]:
    """``text`` cut into parts of about ``size`` characters whose pre-tokens are those of the whole."""
    start = 0
    while len(text) - start > size:
        gap = _GAP.search(text, start + size)
        if gap is None:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:] if start else text


class Counter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, added, split = made["model"], made["added_tokens"], made.get("pre_tokenizer") or {}
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        flags = any(x[f] for x in added for f in ("single_word", "lstrip", "rstrip", "normalized"))
        if model.get("type") != "BPE" or any(model.get(k) for k in odd) or made.get("normalizer") or not plain or flags:
            raise ValueError("a byte-level BPE file that splits texts by the usual pattern is needed")
        vocab = model["vocab"]
        self.byte = np.array([vocab[x] for x in _byte_letters()], np.int64)
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        left, right, self.made = (np.array([vocab[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], "".join))
        born = np.full(max(vocab.values()) + 1, -1)
        born[self.made] = np.arange(len(merges))
        if len(set(self.made.tolist())) < len(merges) or (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge's result takes part in earlier merges")
        pairs = left << 32 | right
        self.rank = np.argsort(pairs).astype(np.int32)
        self.pairs = pairs[self.rank]
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        strings = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        self.strings = strings
        self.pattern = regex.compile(PATTERN)
        self.counts: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.rank[at], _NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that survive of all pieces, which are not empty, end to end, and how many of each."""
        sizes = np.array([len(x) for x in pieces], np.int64)
        symbol = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(symbol), _NONE, np.int32)
        rank[:-1] = np.where(owner[1:] == owner[:-1], self._ranks(symbol[:-1], symbol[1:]), _NONE)
        ended = []
        while len(symbol):
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(start, len(symbol)))
            low = np.minimum.reduceat(rank, start)
            over = np.repeat(low == _NONE, size)
            if over.any():
                ended.append((owner[over], symbol[over]))
                symbol, owner, rank, low = symbol[~over], owner[~over], rank[~over], np.repeat(low, size)[~over]
            else:
                low = np.repeat(low, size)
            at = np.flatnonzero(rank == low)
            if not len(at):
                continue
            # Where hits overlap, in a run of one symbol, every second counts from the left.
            number = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.append(True, np.diff(at) != 1), number, 0))
            at = at[(number - first) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            symbol, owner, rank = symbol[stays], owner[stays], rank[stays]
            new = at - np.arange(len(at))
            for a in (new, new[new > 0] - 1):
                inner = a[a + 1 < len(symbol)]
                rank[a] = _NONE
                rank[inner] = np.where(owner[inner] == owner[inner + 1], self._ranks(symbol[inner], symbol[inner + 1]), _NONE)
        if not ended:
            return symbol, sizes
        owner, symbol = map(np.concatenate, zip(*ended))
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.bincount(owner, minlength=len(pieces))

    def _learn(self, pieces: list[str]) -> None:
        coded = [x.encode("utf-8") for x in pieces]
        for a, b in in_chunks([len(x) for x in coded], MERGED):
            self.counts.update(zip(pieces[a:b], self.merge(coded[a:b])[1].tolist()))

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without strings of added tokens."""
        if text.isascii() or np.frombuffer(text.encode("utf-32-le"), np.uint32).max() < _SETTLED:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.split(text)]

    def count_all(self, found: list[str]) -> list[int]:
        """The number of tokens of each text."""
        out = [0] * len(found)
        parts = []
        for i, text in enumerate(found):
            between = self.special.split(text) if any(x in text for x in self.strings) else [text]
            out[i] += len(between) - 1
            parts += [(i, x) for y in between if y for x in _stretches(y, STRETCH)]
        for a, b in in_chunks([len(x) for _, x in parts], STRETCH):
            split = [self.pieces(x) for _, x in parts[a:b]]
            if len(self.counts) > CACHE:
                self.counts.clear()
            new = {x for own in split for x in own}.difference(self.counts)
            self._learn(list(new))
            for (i, _), own in zip(parts[a:b], split):
                out[i] += sum(map(self.counts.__getitem__, own))
            for x in new:
                if len(x) > KEPT:
                    del self.counts[x]
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each file and Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit. Nothing is shuffled."""

    @tidy
    def run(batches):
        count = counter(path)
        for batch in batches:
            n = pa.array(count.count_all(texts(batch)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return pick.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
