"""The whole pipeline against its stages done plainly, on small tables with planted rows."""

import random

import pytest

pytest.importorskip("tempora.llm")

import corpus_pipeline  # noqa: E402
from tempora.llm.bpe import encoder  # noqa: E402
from tempora.llm.queries import vocabulary  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, set_id int"
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra") for b in ("den", "fer", "gol", "hin", "tas", "wom", "zek")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def stored(spark, path, rows, marks):
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 1) for i, t, lang in rows], DOCS)
    docs.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_pipeline_keeps_what_the_stages_keep(spark, tmp_path):
    rng = random.Random(40)
    rows, marks, good = [], [], {}
    for i in range(240):
        own = prose(rng, rng.randrange(60, 200))
        bad = i % 4 == 0
        rows.append((i, "|||$$# ".join(own.split()[::-1]) + "|||$$##" if bad else own, "aa"))
        marks.append((i, int(not bad), 0))
        if not bad:
            good[i] = own
    rows += [(1000 + i, good[i].replace(" ", "\n"), "aa") for i in (1, 2, 3)]  # copies: of equal length the smaller id stays
    longer = good[5] + "  "
    rows.append((1005, longer, None))  # longer by white space, so it stays
    near = [(2000 + i, " ".join(good[i].split()[:-1] + ["other"]), "aa") for i in (6, 7)]
    rows += near + [(2001, None, None), (2002, "", "aa"), (2003, " \n", "aa"), (None, good[9] + " x", "aa")]
    sf = stored(spark, tmp_path, rows, marks)
    kept = {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        kept[name] = {r["doc_id"] for r in after.collect()}
        docs = after
    packed = corpus_pipeline.run(spark, sf).collect()
    found = {}
    for r in packed:
        found.setdefault(r["doc_id"], []).append(r)
    bad = {i for i in range(240) if i % 4 == 0}
    assert not kept["quality classifier"] & bad and set(good) <= kept["quality classifier"]
    assert set(good) <= kept["language ID"] and not kept["language ID"] & {2001, 2002, 2003}
    assert kept["exact dedup"] == kept["language ID"] - {1001, 1002, 1003, 5}
    assert kept["n-gram Jaccard join"] == kept["exact dedup"] - {2006, 2007, None}
    assert set(found) == kept["n-gram Jaccard join"] == set(good) - {5} | {1005}
    code = encoder(vocabulary())
    for i, own in found.items():
        n = len(code.encode(longer if i == 1005 else good[i])) // 4 + 1
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, n)
            at += r["length"]
        assert at == n


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, stored(spark, tmp_path, [], [])).count() == 0


def test_pipeline_without_texts_or_labels(spark, tmp_path):
    rows = [(None, None, None), (1, "", "aa"), (1, None, "bb"), (2, "12 3", None)]
    assert corpus_pipeline.run(spark, stored(spark, tmp_path, rows, [(1, None, None)])).count() == 0


def test_intermediate_tables_are_deleted(spark, tmp_path):
    import os

    from tempora.llm import common

    stored(spark, tmp_path, [(i, prose(random.Random(i), 30), "aa") for i in range(20)], [])
    folder = common.app_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    result = corpus_pipeline.run(spark, str(tmp_path))
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("stage-n-gram") and result.count() > 0
    with pytest.raises(RuntimeError), common.scratch(spark):
        common.written(spark.range(1), "lost")
        assert any(x.startswith("scratch") for x in os.listdir(folder))
        raise RuntimeError
    assert not any(x.startswith("scratch") for x in os.listdir(folder))
    common.cleanup(spark)
    assert not os.path.exists(folder)
