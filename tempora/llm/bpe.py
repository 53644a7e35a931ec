"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that are side by side inside no token of the vocabulary can never be merged, so every such pair
is a certain cut. Words are cut there, many at once by array operations on their bytes, and each fragment is encoded by
itself; the ids of a text are the fragments' ids in a row. Fragments and words repeat, so each is encoded once for the
bounded caches of a Python worker.

``Encoder`` gives the ids that the tokenizers library gives for the same file with ``add_special_tokens=False`` and
unused truncation and padding. Texts are taken apart at spaces and line feeds, which no token crosses. Words that are
new to the cache take the array path if they are plain letters, digits and marks; others go through the file's own
normaliser and splitter, and words that hold a special token go to the library whole.

Cases: null and empty texts have no ids and decode to the empty text; long texts are processed whole;
repeated rows give repeated rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, texts, tidy

#: Words and fragments that a task keeps; beyond that the later half of its cache goes. Frequent ones come early.
CACHE_WORDS, CACHE_FRAGMENTS = 500_000, 200_000
#: Characters of the longest word that is kept from one text to the next; so a cache is bounded in bytes, too.
KEPT_WORD = 64
#: Characters that are cut at once: few enough for the processor's cache.
CHUNK = 100_000

# Letters that the normaliser leaves alone or lower-cases one by one; marks are printable ASCII.
_PLAIN = regex.compile(r"[!-~À-ÖØ-öø-įı-ſ]*")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[128:] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT


def halve(cache: dict) -> None:
    """Forget the half of a cache that came last."""
    for key in list(islice(cache, len(cache) // 2, None)):
        del cache[key]


class _Cache(dict):
    def __init__(self, make, most):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= KEPT_WORD:
            if len(self) >= self.most:
                halve(self)
            self[key] = value
        return value


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model = made["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self._check(made)
        self.whole = Tokenizer.from_file(path)
        self.last = models.BPE(model["vocab"], merges, end_of_word_suffix=self.suffix or None)
        self.inner = models.BPE(model["vocab"], merges) if self.suffix else self.last
        self.specials = [x["content"] for x in made["added_tokens"]]
        self.shown = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in made["added_tokens"]}
        self.letters = _byte_letters()
        joined = set()
        for token in model["vocab"]:
            bare = token.removesuffix(self.suffix) if self.suffix else token
            joined.update(zip(bare, bare[1:]))
        self.joined = joined
        byte_of = {x: b for b, x in enumerate(self.letters)}
        self.apart = np.ones(1 << 16, bool)
        for a, b in joined:
            if a in byte_of and b in byte_of:
                self.apart[byte_of[a] << 8 | byte_of[b]] = False
        self.cut_out = _Cache(self._cut_out, CACHE_FRAGMENTS)
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _check(made: dict) -> None:
        """The array path and the decoder suit files of one form; others are refused, not coded wrongly."""
        model = made["model"]
        parts = str(made.get("normalizer")), str(made.get("pre_tokenizer"))
        ok = model.get("type") == "BPE" and made.get("decoder") is None and not model.get("byte_fallback") and not model.get("continuing_subword_prefix")
        if not (ok and "Lowercase" in parts[0] and "ByteLevel" in parts[1] and all("<|" in x["content"] for x in made["added_tokens"])):
            raise ValueError("a lower-casing byte-level BPE file without a decoder is needed")

    def _fragment(self, letters: str, is_last: bool) -> list[int]:
        return [x.id for x in (self.last if is_last else self.inner).tokenize(letters)]

    def cuts(self, letters: str) -> list[str]:
        """A word in byte letters, cut between every two that no token has side by side."""
        out, start = [], 0
        for i, pair in enumerate(zip(letters, letters[1:]), 1):
            if pair not in self.joined:
                out.append(letters[start:i])
                start = i
        out.append(letters[start:])
        return out

    def _piece(self, letters: str) -> list[int]:
        *inner, last = self.cuts(letters)
        return [i for x in inner for i in self._fragment(x, False)] + self._fragment(last, True)

    def _odd_word(self, word: str) -> bytes:
        if any(x in word for x in self.specials):
            ids = self.whole.encode(word, add_special_tokens=False).ids
        else:
            normal = self.whole.normalizer.normalize_str(word)
            ids = [i for x, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal) if x for i in self._piece(x)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cut_out(self, fragment: bytes) -> bytes:
        """Ids of a fragment of the array path; a zero byte at its end says that its piece goes on."""
        is_last = fragment[-1] != 0
        bare = fragment if is_last else fragment[:-1]
        ids = self._fragment(bare.decode() if bare.isascii() else "".join([self.letters[b] for b in bare]), is_last)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_plain(self, found: list[str]) -> list[bytes]:
        coded = [x.lower().encode() for x in found]
        own = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
        kind = _KIND[own]
        # A piece ends before i where the kind changes or a digit begins; contractions are pieces of their own.
        ends = np.ones(len(own), bool)
        ends[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        marks = np.flatnonzero(own == 39)
        if len(marks):
            marks = marks[(marks == 0) | (kind[marks - 1] != _OTHER)]
            text = own.tobytes()
            for i in marks.tolist():
                n = 3 if text[i + 1 : i + 3] in (b"re", b"ve", b"ll") else 2 if text[i + 1 : i + 2] in (b"s", b"t", b"m", b"d") else 0
                if n:
                    ends[i + 1 : i + n] = False
                    ends[i + n] = True
        cut = ends.copy()
        cut[1:] |= self.apart.take(own[:-1].astype(np.uint16) << 8 | own[1:])
        solid = kind != _SPACE
        # Spaces go; the others are fragments, told apart by whether their piece ends with them.
        at = np.flatnonzero(cut)
        keep = solid[at]
        begins, stops = at[keep], np.append(at[1:], len(own))[keep]
        text = own.tobytes()
        parts = [text[i:j] for i, j in zip(begins.tolist(), stops.tolist())]
        for i in np.flatnonzero(~np.append(ends, True)[stops]).tolist():
            parts[i] += b"\0"
        values = list(map(self.cut_out.__getitem__, parts))
        to = np.searchsorted(begins, np.cumsum([len(x) + 1 for x in coded])).tolist()
        return [b"".join(values[a:b]) for a, b in zip([0, *to], to)]

    def _learn(self, words: set[str]) -> None:
        """Encode words that the cache lacks, the plain ones at once."""
        plain = [x for x in words if _PLAIN.fullmatch(x) and "<|" not in x]
        for a, b in in_chunks([len(x) + 1 for x in plain], CHUNK):
            self.words.update(zip(plain[a:b], self._encode_plain(plain[a:b])))
        for x in words.difference(plain):
            self.words[x] = self._odd_word(x)

    def encode_all(self, found: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, known = [], self.words
        for a, b in in_chunks([len(x) for x in found], 10 * CHUNK):
            split = [x.replace("\n", " ").split(" ") for x in found[a:b]]
            own = set().union(*split)
            new = own.difference(known)
            if len(known) + len(new) > CACHE_WORDS:
                halve(known)
                new = own.difference(known)
            self._learn(new)
            out += [b"".join(map(known.__getitem__, words)) for words in split]
            for w in new:
                if len(w) > KEPT_WORD:
                    del known[w]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces: what the library's decode gives for a file that names no decoder."""
        return " ".join(map(self.shown.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids and decoded text are made and digested in one pass, so neither is shuffled or written.
    """

    @tidy
    def run(batches):
        code = encoder(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in code.encode_all(texts(batch)):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(code.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pick.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
