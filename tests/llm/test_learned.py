"""Classifiers, language ID, language-model scores, BPE, packing and top-k against brute force or held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tempora.llm")

from tempora.llm import bpe, hmm, langid, packing, quality, topk, toxicity  # noqa: E402
from tempora.llm.queries import vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, score string, held_out int"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "12 34 !!"), (5, "It's the theatre's, they'll SAY naïve Ærø"), (6, "a　b\x85c 中文字 🙂 <|endoftext|> x"), (6, "the end."), (None, "no id. " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", 1) for r in rows], SCHEMA).repartition(3)


def labels(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra") for b in ("den", "fer", "gol", "hin", "tas")]


def test_toxicity_learns_and_scores_every_row(spark):
    rng = random.Random(1)
    rows, marks = list(ODD), [(4, None)]
    for i in range(300):
        bad = i % 3 == 0
        rows.append((100 + i, prose(rng, WORDS, 30) + (" you are an idiot and pathetic trash " if bad else " ") + prose(rng, WORDS, 30)))
        marks += [(100 + i, int(bad))] * (1 + (i % 50 == 0))
    docs = frame(spark, rows)
    got = toxicity.score(docs, toxicity.learn(docs, labels(spark, marks, "toxic"))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 100]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert all(r["predicted"] == ((r["doc_id"] - 100) % 3 == 0) for r in held)
    none = toxicity.score(docs, toxicity.learn(docs, labels(spark, [], "toxic"))).collect()
    assert len(none) == len(rows) and {r["score"] for r in none} == {0.0}


def test_toxicity_classifier_is_where_its_slopes_end():
    rng = np.random.default_rng(4)
    n, features = 400, 60
    has = rng.random((n, features)) < rng.random(features) * 0.3
    has[7] = False  # a text without words
    p = 1 / (1 + np.exp(2 - 4.0 * has[:, 3] + 2.0 * has[:, 5] - 1.0 * has[:, 8]))
    row, found = np.nonzero(has)
    made = toxicity.fit_classifier(found, row, p, features, 5000)
    slope = has.T @ (made.probability(found, row, n) - p) / n + toxicity.L2 * made.coefficients
    used = made.coefficients != 0
    assert np.abs(slope[used] + toxicity.L1 * np.sign(made.coefficients[used])).max() < 1e-4 and np.abs(slope[~used]).max(initial=0) < toxicity.L1 + 1e-4
    assert np.abs(made.coefficients[[3, 5, 8]] - [4, -2, 1]).max() < 0.3


def test_toxicity_fit_keeps_jobs_and_results_of_the_driver_few(spark):
    rng = random.Random(12)
    rows = [(100 + i, prose(rng, WORDS, 20) + (" pathetic " if i % 3 == 0 else " ") + prose(rng, WORDS, 20)) for i in range(100)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("toxicity", "")
    toxicity.learn(frame(spark, rows), labels(spark, [(i, int((i - 100) % 3 == 0)) for i, _ in rows], "toxic"))
    jobs = len(tracker.getJobIdsForGroup("toxicity"))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs < 40  # a job for each step of the fit, with a gradient for every feature, were more


def test_toxicity_tells_words_apart(spark):
    rng = random.Random(10)
    rows = [(100 + i, prose(rng, WORDS, 20) + (" pathetic " if i % 3 == 0 else " ") + prose(rng, WORDS, 20)) for i in range(300)]
    docs = frame(spark, rows)
    model = toxicity.learn(docs, labels(spark, [(i, int((i - 100) % 3 == 0)) for i, _ in rows], "toxic"))
    # The first word shares a bucket of 65,536 with the insult.
    new = frame(spark, [(1, prose(rng, WORDS, 20) + " w1164746"), (2, prose(rng, WORDS, 20) + " pathetic")])
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(new, model).collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize("copied", [[], [0], [0, 0], [2]])
def test_label_model_recovers_planted_rates_whatever_is_voted_twice(copied):
    rng = np.random.default_rng(12)
    toxic = rng.random(50_000) < 0.15
    bad, good = np.array([0.5, 0.3, 0.6, 0.2, 0.4, 0.35]), np.array([0.02, 0.01, 0.05, 0.002, 0.03, 0.02])
    votes = (rng.random((len(toxic), 6)) < np.where(toxic[:, None], bad, good)).astype(int)
    votes = np.concatenate([votes, votes[:, copied]], axis=1) if copied else votes
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.fit_label_model([str(i) for i in range(votes.shape[1])], patterns, counts)
    assert abs(model.prior - 0.15) < 0.02
    assert np.allclose(model.rates[1][:6], bad, atol=0.03) and np.allclose(model.rates[0][:6], good, atol=0.01)
    # A vote cast twice says no more than once: the odds are those of the six independent voters.
    own = patterns[:, :6]
    odds = np.log(0.15 / 0.85) + (own * np.log(bad / good) + (1 - own) * np.log((1 - bad) / (1 - good))).sum(axis=1)
    assert np.average(np.abs(model.posterior(patterns) - 1 / (1 + np.exp(-odds))), weights=counts) < 0.01
    if copied:
        assert all(model.correlations[1][c, 6 + i] > 0.99 for i, c in enumerate(copied))


def test_votes_of_unlabelled_texts_count(spark):
    rows = spark.createDataFrame([("you idiot", ["you", "idiot"])] * 3 + [("fine", ["fine"])] * 5, "text string, words array<string>")
    patterns, counts = toxicity.counted_votes(rows, {"a": F.array_contains("words", "idiot"), "b": F.col("text") == "no"})
    assert sorted(zip(map(tuple, patterns.tolist()), counts.tolist())) == [((0, 0), 5), ((1, 0), 3)]


def test_quality_learns_and_keeps_good(spark):
    rng = random.Random(2)
    rows, marks = list(ODD), [(4, None)]
    for i in range(300):
        good = i % 3 > 0
        own = prose(rng, WORDS, rng.randrange(20, 400))
        rows.append((100 + i, own if good else " ".join(f"{w}|||$$#{w}" for w in own.split()[::-1])))
        marks.append((100 + i, int(good)))
    docs = frame(spark, rows)
    model = quality.learn(docs, labels(spark, marks, "quality"))
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 100]
    assert held and all(r["predicted"] == ((r["doc_id"] - 100) % 3 > 0) for r in held)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect() if (r["doc_id"] or 0) >= 100} == {i for i, good in marks if good}
    weights = quality.attention(docs.filter("doc_id = 101"), model).collect()
    assert math.isclose(sum(r["weight"] for r in weights), 1.0, rel_tol=1e-6)
    assert quality.learn(docs, labels(spark, [], "quality")) is None
    assert quality.keep_good(docs, None).count() == len(rows)


def test_language_id(spark):
    rng = random.Random(3)
    own = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(300)] for lang, letters in {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "éèxyzwvü"}.items()}
    rows = ODD + [(100 + i, prose(rng, own[k], 40), k) for i in range(150) for k in [("aa", "bb", "cc")[i % 3]]]
    docs = frame(spark, rows)
    model = langid.learn(langid.training_rows(docs))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == ("aa", "bb", "cc")[(r["doc_id"] - 100) % 3] for r in got if (r["doc_id"] or 0) >= 100)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(docs.limit(0))).collect()} == {"und"}


def test_gated_attention_and_its_gradients():
    rng = np.random.default_rng(3)
    shapes = {"W": (5, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": ()}
    model = quality.BagModel(np.zeros(5), np.ones(5), {k: np.array(rng.normal(0, 0.7, s)) for k, s in shapes.items()})
    bags, y = [rng.normal(0, 1, (n, 5)) for n in (1, 4, 2, 7)], np.array([1.0, 0.0, 1.0, 0.0])
    p = model.weights

    def plain(bag):
        h = [np.tanh(x @ p["W"] + p["b"]) for x in bag]
        e = np.array([p["w"] @ (np.tanh(p["V"].T @ v) / (1 + np.exp(-(p["U"].T @ v)))) for v in h])
        a = np.exp(e) / np.exp(e).sum()
        return 1 / (1 + math.exp(-(sum(w * v for w, v in zip(a, h)) @ p["c"] + p["d"]))), a

    scores, weights = model.score(bags)
    assert np.allclose(scores, [plain(b)[0] for b in bags]) and all(np.allclose(w, plain(b)[1]) for w, b in zip(weights, bags))
    loss = lambda: -np.mean([math.log(s if t else 1 - s) for s, t in zip([plain(b)[0] for b in bags], y)])
    got = quality.gradients(model, np.concatenate(bags), np.array([0, 1, 5, 7]), y)
    for name in shapes:
        for at in np.ndindex(shapes[name]):
            old, values = float(p[name][at]), []
            for step in (1e-5, -1e-5):
                p[name][at] = old + step
                values.append(loss())
            p[name][at] = old
            assert math.isclose(got[name][at], (values[0] - values[1]) / 2e-5, abs_tol=1e-7), (name, at)


def test_language_masks_and_counts_are_those_of_plain_sets():
    rng = random.Random(13)
    langs = [f"l{i:02d}" for i in range(70)]
    own = [prose(rng, ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(12)], 12) for _ in langs]
    sets = [set(langid.grams([x])[0].tolist()) for x in own]
    keys = np.array(sorted(set().union(*sets)))
    made = langid.build_filter(langs, keys, np.array([[k in s for s in sets] for k in keys.tolist()]))
    mask = made.masks(keys)
    said = np.array([[int(mask[i, n // 64]) >> n % 64 & 1 for n in range(70)] for i in range(len(keys))], bool)
    truth = np.array([[k in s for s in sets] for k in keys.tolist()])
    assert said[truth].all() and abs(said[~truth].mean() - made.false_rate.mean()) < 0.02
    # With no false positives the counts are the sizes of intersections, and the best language is the text's own.
    clean = langid.LanguageFilter(langs, made.table, np.zeros(70))
    clean.masks = lambda found: np.array([[sum(1 << n for n in range(64) if k in sets[n]), sum(1 << n - 64 for n in range(64, 70) if k in sets[n])] for k in found.tolist()], np.uint64)
    texts = [own[i][: rng.randrange(20, 60)] for i in (0, 5, 63, 64, 69)] + ["", "123"]
    names, score = clean.predict(texts)
    for x, name, s in zip(texts, names, score):
        found = langid.grams([x])[0].tolist()
        shares = [sum(k in own_set for k in found) / max(len(found), 1) for own_set in sets]
        assert (name, s) == ((langs[int(np.argmax(shares))], max(shares)) if found else (langid.UNKNOWN, 0.0))


def test_letters_of_all_planes(spark):
    docs = frame(spark, [(100 + i, "\U00030100\U00031000" * 5 if i % 2 else "abc abd", "zz" if i % 2 else "aa") for i in range(20)])
    got = langid.identify(docs, langid.learn(langid.training_rows(docs))).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] % 2} == {"zz"} and {r["lang_pred"] for r in got if r["doc_id"] % 2 == 0} == {"aa"}


def test_keep_identified(spark):
    rows = ODD + [(100 + i, prose(random.Random(i), WORDS, 40), "aa") for i in range(30)]
    docs = frame(spark, rows)
    kept = langid.keep_identified(docs, langid.learn(langid.training_rows(docs)))
    assert kept.columns == docs.columns
    found = [r["doc_id"] for r in kept.collect()]
    assert {i for i in found if (i or 0) >= 100} == {i for i, *_ in rows if (i or 0) >= 100} and not {1, 2, 3, 4} & set(found)
    assert langid.keep_identified(docs.limit(0), langid.learn(docs)).count() == 0


def test_base_score_and_counts_of_the_language_model(spark):
    rng = random.Random(4)
    rows = ODD + [(100 + i, prose(rng, WORDS, rng.randrange(1, 300)) + f" Rare{i % 7}") for i in range(80)]
    got = hmm.score_documents(frame(spark, rows)).collect()
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in hmm.tokens(t or ""))
    total = sum(counts.values())
    low = total + 0.1 * (len(counts) + 1)
    want = []
    for i, t in rows:
        words = hmm.tokens(t or "")
        base = sum(math.log10((counts[w] + 0.1) / low) for w in words)
        want.append((i or 0, len(words), sum(counts[w] > 0 for w in words), total, round(base, 6)))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)


def test_segments_give_the_plain_forward_recursion():
    rng = np.random.default_rng(5)
    k, v = 3, 11
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((v, k)), 0))
    codes = [rng.integers(0, v, n) for n in (1, 2, 63, 64, 65, 500)]
    want = []
    for x in codes:
        a, log = model.start * model.emit[x[0]], 0.0
        for c in x[1:]:
            a = (a @ model.move) * model.emit[c]
            log += math.log10(a.sum())
            a = a / a.sum()
        want.append(log + math.log10(a.sum()))
    assert np.allclose(hmm.log_likelihoods(model, codes), want)


def plain_counts(model, x):
    """Forward-backward over one whole sequence: (start, moves, emissions, log10 P)."""
    k, v = len(model.start), len(model.emit)
    alpha, beta, scale = np.zeros((len(x), k)), np.ones((len(x), k)), np.zeros(len(x))
    for t, c in enumerate(x):
        a = (alpha[t - 1] @ model.move if t else model.start) * model.emit[c]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    moves, emissions = np.zeros((k, k)), np.zeros((v, k))
    for t in range(len(x) - 1, 0, -1):
        right = model.emit[x[t]] * beta[t] / scale[t]
        moves += np.outer(alpha[t - 1], right) * model.move
        beta[t - 1] = model.move @ right
    np.add.at(emissions, x, alpha * beta)
    return alpha[0] * beta[0], moves, emissions, np.log10(scale).sum()


def test_expected_counts_are_those_of_whole_sequences():
    rng = np.random.default_rng(6)
    k, v = 3, 11
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)) ** 4, 1), norm(rng.random((v, k)) ** 4, 0))
    codes = [rng.integers(0, v, n) for n in (1, 2, 63, 64, 65, 128, 500)]
    want = [sum(x) for x in zip(*(plain_counts(model, x) for x in codes))]
    got = hmm.expected(model, codes, v)
    assert math.isclose(got[0].sum(), len(codes), rel_tol=1e-4) and math.isclose(got[1].sum(), sum(map(len, codes)) - len(codes), rel_tol=1e-4)
    assert all(np.allclose(g, w, rtol=1e-3, atol=1e-3) for g, w in zip(got, want))


def test_language_model_is_fitted_until_it_settles(spark):
    rng = np.random.default_rng(7)
    codes = [np.concatenate([rng.integers(0, 9, 60), rng.integers(9, 18, 5_000)]).astype("<u2") for _ in range(6)]
    prior = np.full(18, 1 / 18)
    coded = spark.createDataFrame([(bytearray(x.tobytes()),) for x in codes], "codes binary").repartition(3)
    model = hmm.fit(coded, prior)
    now = hmm.log_likelihoods(model, codes).sum()
    again, told = hmm.baum_welch_round(coded, model, prior)
    assert math.isclose(told, now, rel_tol=1e-5)
    assert abs(hmm.log_likelihoods(again, codes).sum() - now) <= hmm.SETTLED * abs(now)
    # What follows the first 4,096 tokens counts, too.
    assert now / sum(map(len, codes)) > -1.0


def test_bpe_equals_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary()
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    rng = random.Random(6)
    rows = ODD + [(100 + i, "".join(rng.choice("abEs't 0123.,;:-_é\nß ​�中🙂'") for _ in range(200))) for i in range(60)]
    want = []
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        shown = whole.decode(ids, skip_special_tokens=False)
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    got = bpe.round_trip(frame(spark, rows), path).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    path = vocabulary()
    whole = Tokenizer.from_file(path)
    rng = random.Random(7)
    rows = [(i, t) for i, t in ODD if i not in (6, None)] + [(100 + i, prose(rng, WORDS, rng.randrange(0, 3000)) + ".") for i in range(60)]
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    pieces = packing.pack_documents(frame(spark, rows), path).collect()
    by_doc, by_sequence = {}, {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for p in own:
            part = np.array(ids[i][at : at + p["length"]], "<u4").tobytes()
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids[i]), zlib.crc32(part))
            at += p["length"]
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    used = sum(packing.padded(sum(p["length"] for p in own)) for own in by_sequence.values())
    assert used <= 1.05 * sum(map(len, ids.values())) + 3 * 2048


def test_monotone_queue_finds_the_cheapest_chain():
    rng = random.Random(8)
    for _ in range(60):
        where = [0] + sorted(rng.sample(range(1, 120), 25))
        where = [w for w in where if w] and [0, *[w for w in where if w]]
        penalty = [0.0] + [rng.choice([0.0, 4.0, 24.0]) for _ in where[1:]]
        width = 32

        def cost(cuts):
            return sum(packing.padded(b - a, width) - (b - a) + penalty[where.index(b)] for a, b in zip(cuts, cuts[1:]))

        best = {0: 0.0}
        for j, p in enumerate(where[1:], 1):
            steps = [best[i] + packing.padded(p - where[i], width) - (p - where[i]) for i in range(j) if i in best and p - where[i] <= width]
            if steps:
                best[j] = min(steps) + penalty[j]
        if len(best) < len(where):
            continue
        cuts = packing.best_cuts(where, penalty, width)
        assert cuts[0] == 0 and cuts[-1] == where[-1] and math.isclose(cost(cuts), best[len(where) - 1])


def test_top_k_equals_all_products(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(8)]) for i in range(400)]
    rows += [(401, None), (402, []), (450, [1.0, None]), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, [0.5] * 3)]
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in good:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS row")
    got = topk.top_k(vectors).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk.top_k(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e10])
def test_top_k_of_large_components_and_repeated_ids(spark, scale):
    rng = random.Random(10)
    rows = [(i, [rng.choice([0.0, scale, rng.gauss(0, scale)]) if scale < 1e9 else rng.choice([0.0, 1.0, scale if i % 2 else 1e3]) for _ in range(6)]) for i in range(200)]
    if scale < 1e9:
        rows += [(i, [rng.gauss(0, scale) for _ in range(6)]) for i in (0, 1, 50, 50)] + [rows[100], rows[7]]
    good = [[math.floor(256 * x) for x in v] for _, v in rows]
    product = lambda a, b: sum(x * y for x, y in zip(good[a], good[b]))
    want = []
    for q, (i, _) in enumerate(rows):
        if i % 50 == 0:
            scores = sorted((-product(q, c), rows[c][0]) for c in range(len(rows)) if c != q)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_rows_without_an_id_are_candidates(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (None, [2.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (2**63 - 1, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0) == [(0, 1, None), (0, 2, 7), (0, 3, 2**63 - 1), (0, 4, None), (0, 5, 50)]


def test_labelled_rows_are_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(2, f"text {i}") for i in range(500)] + [(3, "other")], "doc_id long, text string")
    marks = labels(spark, [(2, 1), (3, 0)], "toxic")
    assert toxicity.labelled(docs, marks, 10).groupBy("doc_id").count().filter("count > 1").isEmpty()
    assert toxicity.labelled(docs, marks, 1).count() <= 1
    assert len(quality._thinned(np.zeros((5000, 3)))) == quality.LEARNED_PASSAGES and len(quality._thinned(np.zeros((7, 3)))) == 7


@pytest.mark.parametrize("tiny", [1e-8, 1e-10, 1e-30])
def test_counts_of_classes_that_are_hardly_likely(tiny):
    rng = np.random.default_rng(2)
    emit = rng.random((6, 3)) * tiny
    emit[0] = 1 - emit[1:].sum(axis=0)
    model = hmm.Hmm(np.full(3, 1 / 3), np.full((3, 3), 1 / 3), emit)
    codes = [rng.integers(1, 6, n).astype("<u2") for n in (3, 40, 500)]
    start, moves, emissions, likely = hmm.expected(model, codes, 6)
    assert math.isclose(start.sum(), 3, rel_tol=1e-4) and math.isclose(moves.sum(), 540, rel_tol=1e-4) and math.isclose(emissions.sum(), 543, rel_tol=1e-4)
    assert math.isclose(likely, hmm.log_likelihoods(model, codes).sum(), rel_tol=1e-4)


def test_columns_give_the_posteriors_of_the_label_model(spark):
    rng = np.random.default_rng(7)
    names = ["a", "b", "c", "d"]
    votes = (rng.random((400, 4)) < 0.4).astype(np.int64)
    votes[:, 2] = votes[:, 1] ^ (rng.random(400) < 0.1)  # a vote that follows another
    model = toxicity.fit_label_model(names, votes, np.ones(400))
    assert max(model.parents) >= 0
    frame_of = spark.createDataFrame([tuple(map(bool, v)) + (i,) for i, v in enumerate(votes.tolist())], "a boolean, b boolean, c boolean, d boolean, i int")
    got = frame_of.select("i", toxicity.posterior(model, {n: F.col(n) for n in names}).alias("p")).orderBy("i").toPandas()["p"].to_numpy()
    assert np.allclose(got, model.posterior(votes), atol=1e-12)


def test_top_k_refuses_what_64_bits_do_not_hold(spark):
    for big in (1e18, 1e30):
        with pytest.raises(Exception):  # noqa: B017
            topk.top_k(spark.createDataFrame([(0, [big]), (1, [big])], "vec_id long, embedding array<double>")).collect()


def test_empty_tables(spark):
    docs = frame(spark, ODD).limit(0)
    path = vocabulary()
    assert toxicity.score(docs, toxicity.learn(docs, labels(spark, [], "toxic"))).count() == 0
    assert quality.score(docs, quality.learn(docs, labels(spark, [], "quality"))).count() == 0
    assert langid.identify(docs, langid.learn(docs)).count() == 0
    assert hmm.score_documents(docs).count() == 0
    assert bpe.round_trip(docs, path).count() == 0
    assert packing.pack_documents(docs, path).count() == 0


def test_a_full_cache_keeps_the_words_that_came_first():
    made = []
    cache = bpe._Cache(lambda key: made.append(key) or key, 4)
    for key in ["the", "of", "x1", "x2", "x3", "the", "of", "x1"]:
        assert cache[key] == key
    assert made == ["the", "of", "x1", "x2", "x3", "x1"]


def test_places_at_unpadded_distances():
    rng = random.Random(21)
    where = sorted(rng.sample(range(5, 400), 120))
    want = [[where.index(p - (1 << k)) for k in range(7) if p - (1 << k) in where] for p in where]
    assert packing.unpadded(where, 64) == want
