from __future__ import annotations

import os
import random

import corpus_pipeline as C
from tesserae.llm import pieces
from tesserae.sources import scratch

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_planted_rows(spark, tmp_path):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice(["ta", "ri", "no", "sel", "mu"]) for _ in range(rnd.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, one = text(70), text(90)
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        t = text(60) + (" gruk" + word() + " gruk" + word() if bad else "")
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(bad)))
    rows += [(500 + i, one, "en", "s0", len(one)) for i in range(5)]
    rows += [(600 + i, f"{text(40)} {shared} {text(40)}", "en", "s1", None) for i in range(4)]
    rows += [(700, None, None, None, None), (701, "", "en", "s2", 0), (None, text(30), "en", "s0", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != C.STAGES[-1][0]:
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = lambda n: [r.doc_id for r in seen[n]]
    after = set(ids("toxicity"))
    assert sum(i in after for i in range(0, 160, 4)) <= 4 and sum(i in after for i in range(160) if i % 4) >= 115
    assert {500, 600, 700, 701, None} <= after
    one_each = ids("ngram_jaccard_join")
    assert one_each.count(500) == 1 and not {501, 502, 503, 504} & set(one_each) and len(one_each) == len(after) - 4
    cut = {r.doc_id: r for r in seen["substring_dedup"]}
    assert shared in cut[600].text and all(shared not in cut[i].text and len(cut[i].text) < 700 for i in (601, 602, 603)) and set(cut) == set(one_each)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.values())
    assert set(ids("mixing")) == set(cut)
    with open(pieces.MODEL, "rb") as f:
        model = pieces.Model(f.read())
    for r in seen["sentencepiece"]:
        assert list(r.ids) == model.encode(cut[r.doc_id].text or "").tolist()


def test_texts_are_cut_once(spark, monkeypatch):
    """Filters on the cut text stay above the cut: below it, each text is cut twice, by twice the workers."""
    monkeypatch.setattr(C.passages, "find", lambda docs: spark.createDataFrame([(1, 0, 6), (2, 0, 3)], "id long, begin long, end long"))
    docs = spark.createDataFrame([(1, "abcde fg", "en", "s", 8), (2, "abc", "en", "s", 3), (3, "", "en", "s", 0), (4, "é", "en", "s", 1)], COLUMNS)
    out = C.cut_shared_passages(spark, docs, "")
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, "fg", 2), (3, "", 0), (4, "é", 1)}
    assert str(out._jdf.queryExecution().sparkPlan()).count("EvalPython") == 1


def test_run_on_the_small_tables(spark, small):
    out = C.run(spark, small)
    assert out.columns == ["doc_id", "ids", "n_ids", "round_trip"] and out.count() > 0


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_stages_leave_no_tables_but_what_they_read(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}", "en", "s", 29) for i in range(8)], COLUMNS)
    folder = scratch.shared_dir(spark).removeprefix("file:")
    for stage, label in ((C.keep_one_of_group, "heads"), (C.cut_shared_passages, "ranges")):
        before = set(os.listdir(folder))
        out = stage(spark, docs, "")
        assert [x.split("-")[1] for x in set(os.listdir(folder)) - before] == [label]
        assert out.count() >= 1
