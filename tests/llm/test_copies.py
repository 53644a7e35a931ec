"""Exact dedup, the n-gram join, line dedup and components against brute force on small tables."""

import hashlib
import random

import pytest

pytest.importorskip("tempora.llm")

from tempora.llm import exact_dedup, line_dedup, ngram_join  # noqa: E402
from tempora.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, keep_id string, place int"


def frame(spark, rows):
    """Documents with two more columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, None, "k", 7) for i, t in rows], SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(["alder", "birch", "cedar", "elm", "fir", "larch", "oak", "pine", "rowan", "yew"]) + str(rng.randrange(9)) for _ in range(n))


def stripped(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


EXACT = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, " \n"), (6, "c"), (7, "a b"), (8, "c"), (8, "c"), (None, "c"), (9, "x" * 300_000), (10, "x" * 300_000 + " ")]


def groups(rows):
    """(doc_id, keep_id, size, digest) of each row, and how often each (keep_id, digest) is to be kept: once."""
    out, kept = [], {}
    for i, t in rows:
        group = [(j, u or "") for j, u in rows if stripped(u) == stripped(t)]
        keep, _ = min(group, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        digest = hashlib.sha256(stripped(t).encode()).hexdigest()
        out.append((i, keep, len(group), digest))
        kept[keep, digest] = 1
    return sorted(out, key=str), kept


def check_groups(got, rows):
    want, kept = groups(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    found = {}
    for r in got:
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            found[r["keep_id"], r["text_sha256"]] = found.get((r["keep_id"], r["text_sha256"]), 0) + 1
    assert found == kept


def test_exact_duplicates(spark):
    check_groups(exact_dedup.exact_duplicates(frame(spark, EXACT)).collect(), EXACT)


def test_exact_duplicates_in_three_rounds(spark):
    rng = random.Random(31)
    rows = [(rng.choice([None, rng.randrange(300)]) if rng.random() < 0.3 else 1000 + i, prose(rng, rng.randrange(1, 3)) + " " * rng.randrange(3)) for i in range(600)]
    rows += [(5000 + i, "the same\ttext" + " " * (i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(70)
    check_groups(exact_dedup.exact_duplicates(docs).collect(), rows)
    found = exact_dedup.digests(docs)
    plan = exact_dedup.copied(found)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1].count("FlatMapGroupsInArrow") == 3


def test_merging_sorted_runs():
    rng = exact_dedup.np.random.default_rng(4)
    rows = exact_dedup.np.zeros(900, exact_dedup._ENTRY)
    rows["digest"] = [hashlib.sha256(str(x).encode()).digest() for x in rng.integers(0, 200, 900)]
    rows["n_points"], rows["keep_id"], rows["row"], rows["copies"] = rng.integers(0, 3, 900), rng.integers(0, 9, 900), range(900), 1
    rows["nameless"] = rng.random(900) < 0.2
    rows["proof"] = [int.from_bytes(x.ljust(32, b"\0")[:7], "big") for x in rows["digest"].tolist()]
    runs = [exact_dedup.merged([x[exact_dedup.np.argsort(x["digest"], kind="stable")]]) for x in exact_dedup.np.array_split(rows, 7)]
    got = exact_dedup.merged([exact_dedup.merged(runs[:3]), exact_dedup.merged(runs[3:])])
    want = []
    for d in sorted(set(rows["digest"].tolist())):
        group = [r for r in rows.tolist() if r[0] == d]
        best = min(group, key=lambda r: (-r[1], r[2], r[3], r[4]))
        want.append((*best[:6], len(group)))
    assert got.tolist() == want
    rows["proof"][0] += 1
    if (rows["digest"] == rows["digest"][0]).sum() > 1:
        with pytest.raises(ValueError):
            exact_dedup.merged([rows[exact_dedup.np.argsort(rows["digest"], kind="stable")]])


def test_keep_one_of_ids_that_repeat_or_lack(spark):
    rows = [(1, "a b"), (1, "c"), (2, "ab"), (2, "d"), (None, "c"), (None, "e"), (None, "e "), (None, None), (3, ""), (4, "f"), (4, "f"), (4, "f  ")]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in exact_dedup.keep_one(frame(spark, rows)).collect())
    assert kept == [(0, "e "), (1, "a b"), (1, "c"), (2, "d"), (3, ""), (4, "f  ")]


def test_keep_one_leaves_one_row_of_each_text(spark):
    docs = frame(spark, EXACT)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(stripped(r["text"]) for r in rows) == sorted({stripped(t) for _, t in EXACT})
    assert {r["doc_id"] for r in rows} == {3, 5, 6, 7, 10}


def shingles(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def classes(rows, words, share):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= share * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    low = {}
    for i, (own, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), own), own)
    return sorted((own, len(sets[i]), low[top(i)]) for i, (own, _) in enumerate(rows))


def near_copies(seed, n=150):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 8, 40, 120])) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one"), (7, "é x y z w"), (8, "É x y z w")]
    for i in range(n):
        words = rng.choice(base[: 1 + i % 12]).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(4)}"
        rows.append((100 + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("words, share, sizes", [(4, 85, {}), (5, 80, {"short": 4, "chunk": 6}), (4, 85, {"short": 8, "chunk": 16, "hot": 20})])
def test_ngram_join_equals_all_pairs(spark, words, share, sizes):
    rows = near_copies(words)
    got = ngram_join.similarity_classes(frame(spark, rows), words, share, **sizes)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == classes(rows, words, share)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 64, "hot": 50}])
def test_ngram_join_of_a_large_group(spark, sizes):
    """One group of edited copies, most in one list, and texts that share a passage with it but are no copies."""
    rng = random.Random(21)
    base = prose(rng, 60).split()
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(40, 60)] = f"new{rng.randrange(50)}"
        rows.append((i + 1, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:30]) + " " + prose(rng, 60)) for i in range(60)]
    got = ngram_join.similarity_classes(frame(spark, rows), 4, 85, **sizes)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == classes(rows, 4, 85)


def test_ngram_join_keeps_smallest_of_each_class(spark):
    rows = near_copies(3, 60)
    docs = frame(spark, rows)
    kept = ngram_join.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in classes(rows, 5, 80)}


def test_ngram_join_keeps_rows_whose_ids_repeat_or_lack(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda at: " ".join("other" if i == at else w for i, w in enumerate(words))
    clean = " ".join(f"c{i}" for i in range(40))
    rows = [(1, near(0)), (2, clean), (2, near(59)), (3, near(59)), (None, near(58)), (5, None), (5, " "), (None, None)]
    rows += [(None, " ".join(f"n{i}" for i in range(30)))] * 3 + [(7, " ".join(f"r{i}" for i in range(30)))] * 2
    kept = sorted(((r["doc_id"] or 0), (r["text"] or "")[:3]) for r in ngram_join.keep_one_each(frame(spark, rows)).collect())
    assert kept == [(0, ""), (0, "n0 "), (1, "oth"), (2, "c0 "), (5, ""), (5, " "), (7, "r0 ")]


def test_bound_is_never_below_the_overlap():
    rng = random.Random(5)
    for _ in range(50):
        a, b = (ngram_join.shingle_set(prose(rng, rng.randrange(1, 600)), 2) for _ in range(2))
        both = len(set(a.tolist()) & set(b.tolist()))
        points = [ngram_join.np.frombuffer(ngram_join.point(x), ngram_join.np.uint8) for x in (a, b)]
        assert ngram_join.bound(*points, len(a), len(b)) >= both


def test_trees_with_levels_find_every_pair_whose_bound_reaches():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 4, (40, ngram_join.GROUPS))
    make = lambda n: np.maximum(base[rng.integers(0, 40, n)] + rng.integers(-1, 2, (n, ngram_join.GROUPS)) * (rng.random((n, ngram_join.GROUPS)) < 0.05), 0).astype(np.uint8)
    a, b = make(1500), make(40)
    a[750:] *= 4  # sets of another size, whose boxes are passed over
    na, nb = a.sum(axis=1, dtype=np.int64), b.sum(axis=1, dtype=np.int64)
    left, right = ngram_join.RTree(a, na), ngram_join.RTree(b, nb)
    assert len(left.high) > 3 and len(left.high[-1]) == 1
    want = set()
    for j in range(40):
        reach = ngram_join.bound(a, b[j][None], na, nb[j]) >= ngram_join.needed(na, nb[j], 85)
        want |= {(i, j) for i in np.flatnonzero(reach & (100 * na >= 85 * nb[j]) & (100 * nb[j] >= 85 * na)).tolist()}
    assert set(zip(*(x.tolist() for x in ngram_join.tree_join(left, right, 85)))) == want and want
    met = len(ngram_join._near_boxes(left, right, 85)[0])
    assert met < len(left.starts) * len(right.starts)


def test_second_meetings_copy_the_largest_component_once_for_each_chunk_of_the_others(spark):
    from pyspark.sql import functions as F

    grouped = spark.range(2000).select(F.lit(1).cast("long").alias("list"), F.col("id").alias("set_id"), F.when(F.col("id") < 1900, 0).otherwise(F.col("id")).cast("long").alias("component"))
    rng = random.Random(2)
    texts = {i: prose(rng, 30) for i in range(2000)}
    texts |= {1950 + k: texts[k] + " elm1" for k in range(20)}
    sets = {i: ngram_join.shingle_set(t, 4) for i, t in texts.items()}
    rows = [(i, len(x), bytearray(ngram_join.point(x)), bytearray(ngram_join.packed(x))) for i, x in sets.items()]
    got = ngram_join._second(grouped, spark.createDataFrame(rows, ngram_join.MEMBERS), 85, 100).collect()
    assert sorted((r.a, r.b) for r in got) == [(k, 1950 + k) for k in range(20)]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def brute_lines(rows, min_words):
    """Lines to delete: every run of at least ``min_words`` words that has an earlier copy."""
    docs = []
    for own, t in sorted({(i, t) for i, t in rows if t}):
        docs.append((own, t, [y.strip() for y in t.encode().split(b"\n") if y.strip()]))
    seen, gone = set(), {}
    for own, t, lines in docs:
        for at in range(len(lines)):
            total = 0
            for end in range(at, len(lines)):
                total += len(lines[end].split())
                if total >= min_words:
                    run = tuple(lines[at : end + 1])
                    if run in seen:
                        gone.setdefault((own, t), set()).update(range(at, end + 1))
                    seen.add(run)
                    break
    return gone


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    pool = [prose(rng, rng.choice([1, 2, 3, 5, 12])) for _ in range(14)]
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, "\n".join([pool[0]] * 12))]
    for i in range(60):
        rows.append((10 + i, "\n".join(rng.choice(pool) + rng.choice(["", " "]) if rng.random() < 0.9 else "" for _ in range(rng.randrange(1, 12)))))
    rows.append(rows[-1])
    gone = brute_lines(rows, line_dedup.MIN_WORDS)
    want = sorted((i, line_dedup.without(t, [(p, 1) for p in gone.get((i, t), ())])[0] if t else "", len(gone.get((i, t), ()))) for i, t in rows)
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"], r["n_deleted"]) for r in got) == want
    assert any(n for _, _, n in want)


def test_line_dedup_deletes_short_lines(spark):
    rows = [(i, f"own{i} line\nLicensed under the Apache License, Version 2.0\nBack to top\n\nend{i}") for i in range(1, 4)]
    got = {r["doc_id"]: (r["n_deleted"], r["text"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, "own2 line\n\nend2"), 3: (2, "own3 line\n\nend3")}


def line_rows(seed):
    rng = random.Random(seed)
    pool = [f"line {i}" for i in range(5)] + ["common"] * 3
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(40)]
    whole = "\n".join(f"own {i % 7}" for i in range(20))
    return rows + [(100, whole), (101, whole), (102, whole + "\nend"), (103, whole[8:]), (104, "alone"), (None, rows[3][1]), (105, None), (106, " \n")]


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_suffix_array_common_prefixes_and_spans_equal_brute_force(spark, block):
    rows = line_rows(block)
    lines = line_dedup.lines_of(frame(spark, rows))
    by_n = {r.n: bytes(r.mark) for r in lines.collect()}
    below = {r.n: r.below for r in lines.collect()}
    suffix = {n: [by_n[n + i] for i in range(below[n])] for n in by_n}
    repeated = {m for m in by_n.values() if list(by_n.values()).count(m) > 1}
    want = sorted((n for n in suffix if suffix[n][0] in repeated), key=lambda n: (suffix[n], n))

    def common(a, b):
        n = 0
        while n < min(len(suffix[a]), len(suffix[b])) and suffix[a][n] == suffix[b][n]:
            n += 1
        return n

    array = line_dedup.suffix_array(lines)
    got = array.orderBy("at").collect()
    assert [r.n for r in got] == want and [r["at"] for r in got] == list(range(1, len(want) + 1))
    assert [r.common for r in got] == [0, *(common(a, b) for a, b in zip(want, want[1:]))]
    spans = {r.n: r.span for r in line_dedup.repeated_spans(array, block).collect()}
    longest = {n: max((common(n, m) for m in want if m < n), default=0) for n in want}
    assert spans == {n: x for n, x in longest.items() if x}


def test_a_null_id_comes_after_the_largest(spark):
    rows = [(None, "one line\ntwo"), (2**63 - 1, "one line\ntwo"), (0, "other")]
    got = {r["doc_id"]: r["n_deleted"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {0: 0, 2**63 - 1: 0, None: 2}


def brute_maximal(rows, min_words):
    """Lines to delete: every match with an earlier place, extended to its maximal run, of at least ``min_words`` words."""
    docs = []
    for own, t in sorted({(i, t) for i, t in rows if t}):
        docs.append((own, t, [y.strip() for y in t.encode().split(b"\n") if y.strip()]))
    spots, gone = [(d, at) for d in range(len(docs)) for at in range(len(docs[d][2]))], {}
    for n, (d, at) in enumerate(spots):
        own, t, lines = docs[d]
        for e, other in spots[:n]:
            before, long = docs[e][2], 0
            while at + long < len(lines) and other + long < len(before) and lines[at + long] == before[other + long]:
                long += 1
            if sum(len(x.split()) for x in lines[at : at + long]) >= min_words:
                gone.setdefault((own, t), set()).update(range(at, at + long))
    return gone


@pytest.mark.parametrize("min_words", [1, 10])
def test_line_dedup_deletes_maximal_runs(spark, min_words):
    rng = random.Random(min_words)
    pool = [prose(rng, rng.choice([1, 2, 3, 5, 20])) for _ in range(30)]
    passage = [prose(rng, rng.choice([3, 4, 20])) for _ in range(25)]
    rows = [(1, f"{prose(rng, 20)}\na b c\nown end"), (3, "\n".join([pool[0], pool[1]] * 9))]
    rows.append((2, "other front\n" + rows[0][1].rpartition("\n")[0]))
    for i in range(40):
        a = rng.randrange(25)
        rows.append((10 + i, "\n".join([rng.choice(pool) for _ in range(rng.randrange(6))] + passage[a : a + rng.randrange(25)] + [rng.choice(pool) for _ in range(rng.randrange(6))])))
    gone = brute_maximal(rows, min_words)
    want = sorted((i, line_dedup.without(t, [(p, 1) for p in gone.get((i, t), ())])[0] if t else "", len(gone.get((i, t), ()))) for i, t in rows)
    got = line_dedup.dedup_lines(frame(spark, rows), min_words).collect()
    assert sorted((r["doc_id"], r["text"], r["n_deleted"]) for r in got) == want
    assert any(n for _, _, n in want)


def rows_shuffled(spark, run):
    """Rows written to shuffles while ``run`` runs."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = max(stages(), default=-1)
    run()
    return sum(n for k, n in stages().items() if k > before)


def test_lines_that_occur_once_take_no_part_in_the_rounds(spark):
    whole = "\n".join(f"shared {i}" for i in range(100))
    rows = [(i, "\n".join(f"own {i} {j}" for j in range(50))) for i in range(80)] + [(100, whole), (101, whole + "\nend")]
    lines = line_dedup.lines_of(frame(spark, rows))
    assert rows_shuffled(spark, lambda: line_dedup.suffix_array(lines).count()) < 3 * lines.count()


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 3)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("keys", [1, 2, 30])
def test_places_of_keys_that_fill_several_ranges(spark, small_batches, keys):
    rng = random.Random(keys)
    rows = [(rng.randrange(-1, keys - 1) * 2, rng.randrange(-1, keys - 1), n, n - n % 5) for n in range(150)]
    got = line_dedup._placed(spark.createDataFrame(rows, "rank long, next long, n long, run long"), ["rank", "next"], 1).orderBy("at").collect()
    rows.sort()
    assert [(r["rank"], r.next, r.n, r.run) for r in got] == rows and [r["at"] for r in got] == list(range(150))
    pairs, ranks = [r[:2] for r in rows], [r[0] for r in rows]
    assert [(r["first"], r.outer, r.shared) for r in got] == [(pairs.index(r[:2]), ranks.index(r[0]), pairs.count(r[:2]) > 1) for r in rows]
    assert [(r.m, r.m_run) for r in got[1:]] == [r[2:] for r in rows[:-1]]


def test_line_dedup_in_small_batches(spark, small_batches):
    rows = line_rows(11)
    gone = brute_maximal([r for r in rows if r[0] is not None], 1)
    got = line_dedup.dedup_lines(frame(spark, [r for r in rows if r[0] is not None])).collect()
    assert {r["doc_id"]: r["n_deleted"] for r in got} == {i: len(gone.get((i, t), ())) for i, t in rows if i is not None}


def test_empty_tables(spark):
    docs = frame(spark, EXACT).limit(0)
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.keep_one(docs).count() == 0
    assert ngram_join.similarity_classes(docs).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0
