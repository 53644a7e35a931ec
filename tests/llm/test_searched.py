"""Ranked search, token counts and the prefix trie against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("tempora.llm")

from tempora.llm import prefix_trie, ranked_search, token_counts  # noqa: E402
from tempora.llm.queries import vocabulary  # noqa: E402

CLASHING = "doc_id long, text string, score string, rank string, item long, n_tokens string"
ODD = [(1, None), (2, ""), (3, " \n\t!"), (4, "Elm elm ELM, oak"), (4, "Elm elm ELM, oak"), (None, "oak"), (None, "elm oak"), (5, "Ärger ärger élan"), (6, "oak " * 60_000), (7, "elm-oak_elm")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "r", 9, "n") for r in rows], CLASHING).repartition(3)


def found_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_ranks(docs, items, most):
    """(item_id, rank, doc_id, score) rows, sorted."""
    split = [(i, found_terms(t)) for i, t in docs]
    held = Counter(w for _, own in split for w in set(own))
    n, every = sum(1 for _, own in split if own), sum(len(own) for _, own in split)
    out = []
    for item, text in items:
        scores = []
        for i, own in split:
            tf, score = Counter(own), 0
            m = 75 + 25 * len(own) * n // every if own else 0
            for w in found_terms(text):
                if tf[w]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * held[w] + 1))) * (1000000000 * tf[w] // (1000 * tf[w] + 12 * m))
            if score:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def random_docs(seed, n):
    rng = random.Random(seed)
    words = ["alder", "birch", "cedar", "elm", "fir", "larch", "oak", "pine", "rowan", "yew", "œuvre", "x1", "The"]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights=[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 1, 1, 60], k=rng.randrange(1, 40)))) for i in range(100, 100 + n)]


ITEMS = [(1, "elm oak oak"), (2, None), (3, ""), (4, "unheard of"), (5, "Ärger"), (5, "the THE yew"), (None, "oak")]


@pytest.mark.parametrize("sizes", [{}, {"block_items": 2}, {"most": 3, "block_chars": 8}])
def test_ranks_equal_brute_force(spark, sizes):
    docs = ODD + random_docs(1, 300)
    items = spark.createDataFrame([(i, t, 5, "x") for i, t in ITEMS], "item_id long, text string, doc_id int, score string")
    got = ranked_search.rank_documents(frame(spark, docs), items, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranks(docs, ITEMS, sizes.get("most", 20))


def test_equal_scores_are_ranked_by_id_over_many_tasks(spark):
    docs = [(i, "elm oak") for i in range(500)] + [(i, "pine") for i in range(500, 520)]
    frame_of = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    got = ranked_search.rank_documents(frame_of, spark.createDataFrame([(1, "oak")], "item_id long, text string")).orderBy("rank").collect()
    assert [(r["rank"], r.doc_id) for r in got] == [(k + 1, k) for k in range(20)] and len({r.score for r in got}) == 1


def test_heaps_are_bounded():
    heaps = ranked_search.Heaps(1, 3)
    for i, score in enumerate([5, 1, 9, 5, 5, 7]):
        heaps.add(0, score, 10 - i)
        assert len(heaps.rows[0]) <= 3
    assert sorted(heaps.rows[0], reverse=True) == [(9, True, -8), (7, True, -5), (5, True, -6)] and heaps.least[0] == 5


@pytest.mark.parametrize("docs, items", [([], []), ([], ITEMS), (ODD, []), ([(1, ""), (2, None)], ITEMS)])
def test_ranks_of_empty_tables(spark, docs, items):
    got = ranked_search.rank_documents(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert got.count() == 0


def byte_file():
    return vocabulary("byte_bpe_50k.json", "TEMPORA_BYTE_VOCABULARY")


def odd_texts():
    rng = random.Random(3)
    out = ["a" * 999, " " * 500 + "x", "<|endoftext|>a <|endoftext|><|endoftext|>", "՘x 中文 日本 𝒳 👍🏽", "a  b\x1c c\x85d  \n\n e", "'s 'LL'll 're", "\n", "١٢٣ ⅷ²"]
    out += ["".join(rng.choice("ab c'sl\né中<|>1") for _ in range(150)) for _ in range(60)]
    return out + ["".join(rng.choice("abcdefgh0123+/") for _ in range(5000)), "the tree is a tree " * 20_000]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_file())
    docs = ODD + list(enumerate(odd_texts(), 50))
    got = token_counts.count_tokens(frame(spark, docs), byte_file())
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for i, t in docs:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(frame(spark, []), byte_file()).count() == 0


def test_surviving_symbols_are_the_librarys_ids():
    from tokenizers import Tokenizer

    counter, library = token_counts.counter(byte_file()), Tokenizer.from_file(byte_file())
    pieces = [p for t in odd_texts() for p in counter.pieces(t.replace("<|", "<"))]
    symbols, sizes = counter.merge([p.encode() for p in pieces])
    want = [library.encode(p, add_special_tokens=False).ids for p in pieces]
    assert symbols.tolist() == [i for ids in want for i in ids] and sizes.tolist() == [len(ids) for ids in want]
    assert [x.tolist() for x in counter.merge([])] == [[], []]


def test_long_texts_are_cut_where_no_piece_crosses():
    counter = token_counts.counter(byte_file())
    for text in odd_texts():
        parts = list(token_counts._stretches(text, 40))
        assert "".join(parts) == text and [p for x in parts for p in counter.pattern.findall(x)] == counter.pattern.findall(text)


def test_token_counts_refuse_other_files():
    with pytest.raises(ValueError):
        token_counts.Counter(vocabulary())


def brute_trie(rows):
    """Nodes as tuples in the order of the columns, sorted by (conv_id, depth)."""
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            given[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(own)] for c, own in given.items()}
    whole, members = {}, defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(own) if len(whole[c]) == len(p)) for p, own in members.items()}
    nodes = [(min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, own in members.items()]
    return sorted(nodes, key=lambda x: x[:2])


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, name string, size int").repartition(3)


def talk(seed, n, longest):
    """Conversations that share many first turns, copies of whole ones among them."""
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            out.append((c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "user", rng.choice(["yes", "no", "né", ""]) if rng.random() < 0.4 else "go on"))
    return out


ODD_TURNS = [(None, 0, "user", "lost"), (10, None, None, None), (10, None, "user", None), (10, 3, None, "x"), (10, 3, "user", "x"), (10, 3, "user", "x"), (12, 0, "user", "é" * 5000), (13, 7, "a", "b"), (14, -1, "user", "go on")]
TURNLESS = [(c, 0, "user", "go on") for c in (16, 17, 18, 19, 21, 22)]


@pytest.mark.parametrize("block", [1, 8, 256])
def test_trie_equals_brute_force(spark, block):
    rows = ODD_TURNS + TURNLESS + [(c + 100, *x) for c, *x in talk(5, 60, 12)] + [(333, t, "user", "go on") for t in range(30)]
    got = prefix_trie.prefix_trie(conversations(spark, rows), block)
    assert got.columns == prefix_trie.COLUMNS
    assert sorted(map(tuple, got.collect()), key=lambda x: x[:2]) == brute_trie(rows)


def test_trie_of_turnless_conversations_and_of_none(spark):
    only = [(c, 0, "user", "x") for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9][:3]
    (root,) = prefix_trie.prefix_trie(conversations(spark, only)).collect()
    assert [tuple(root)] == brute_trie(only) and root.n_leaves == 1 and root.n_convs == 3
    none = prefix_trie.prefix_trie(conversations(spark, [(None, 1, "a", "b")]))
    assert none.columns == prefix_trie.COLUMNS and none.count() == 0


def test_ends_of_one_node_are_digested_from_many_texts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "JOINED", 7)
    rows = [(c, 0, "user", "x") for c in range(0, 1500, 5)]
    got = prefix_trie.prefix_trie(conversations(spark, rows)).collect()
    assert sorted(map(tuple, got), key=lambda x: x[:2]) == brute_trie(rows)


def test_turns_are_numbered_over_ranges(spark):
    rows = [(1, t * 7919 % 3000, "u", "x") for t in range(3000)] + [(c, t, "u", "y") for c in (0, 2, 3) for t in range(5)]
    got = prefix_trie.numbered_turns(conversations(spark, rows)).select("conv_id", "pos").collect()
    assert sorted(map(tuple, got)) == sorted([(1, p + 1) for p in range(3000)] + [(c, p + 1) for c in (0, 2, 3) for p in range(5)])
