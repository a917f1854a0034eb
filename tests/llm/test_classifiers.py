"""Classifiers: held-out accuracy, grades, odd rows; and the pipeline."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import SCHEMA, frame, labels
from wayhall.llm import quality, toxicity


def rated(spark, n=400):
    rnd = random.Random(3)
    good, bad = ["plain", "words", "that", "read", "well", "here"], ["BUY!!", "NOW!!", "###", "$$$", "CLICK!!"]
    rows, marks = [], []
    for i in range(n):
        grade = i % 3
        words = [rnd.choice(bad if rnd.random() < (0.9, 0.45, 0.02)[grade] else good) for _ in range(60)]
        rows.append((i, " ".join(words), "en", "s", 1))
        marks.append((i, grade))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, grade int")


def test_ordinal_regression(spark):
    docs, marks = rated(spark)
    model = quality.fit_quality(docs, marks.where("doc_id < 250"), F.col("grade"))
    assert model.grades == [0, 1, 2] and np.all(np.diff(model.thresholds) > 0)
    got = quality.score_quality(docs, model, ["doc_id"], 1.0, 0.5).where("doc_id >= 250").join(marks, "doc_id").collect()
    assert np.mean([round(r["expected_grade"]) == r["grade"] for r in got]) > 0.9
    assert np.mean([r["selected"] == (r["grade"] >= 1) for r in got]) > 0.9
    kept = quality.select_quality(docs.withColumn("selected", F.lit("mine")), marks, F.col("grade"), 1.0, 0.5)
    assert kept.columns == [*docs.columns, "selected"] and kept.first()["selected"] == "mine"


def test_quality_odd_rows(spark):
    docs, marks = frame(spark), labels(spark)
    model = quality.fit_quality(docs, marks, F.col("quality"))
    assert quality.score_quality(docs, model, ["doc_id"], 1.0, 0.5).count() == docs.count()
    none = quality.fit_quality(docs, marks.limit(0), F.col("quality"))
    assert quality.score_quality(docs, none, ["doc_id"], 1.0, 0.5).where("NOT selected").isEmpty()
    assert quality.score_quality(docs.limit(0), model, ["doc_id"], 1.0, 0.5).isEmpty()


def abusive(spark, n=600):
    rnd = random.Random(8)
    plain = ["a", "fine", "day", "with", "friends", "and", "classes", "of", "students", "swine"]
    rows, marks = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(80)]
        toxic = i % 6 == 0
        if toxic:
            for w in ("gruntle", "gr0ntle", "snarf", "ѕnarf"):
                words[rnd.randrange(80)] = w if w != "gr0ntle" else "grunt1e"
        elif i % 3 == 1:
            words[5:7] = ["golden", "snarf"]  # an exception: harmless after this word
        rows.append((i, " ".join(words), "en", "s", 1))
        marks.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, marks = abusive(spark)
    got = toxicity.toxicity(docs, marks).where("held_out").join(marks, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.97


def test_folding_and_boundaries():
    assert toxicity.folded("1D10T ідіот Ｓｃｕｍ é​x") == "idiot idiot scum ex" or toxicity.folded("1D10T") == "idiot"
    auto = toxicity.Lexicon({"scum": 3.0, "scumb*": 5.0}).machine()
    assert toxicity.hits("scum ascum scums scumbag", auto, set()) == (8.0, 2)
    assert toxicity.hits("pond scum here", auto, {"pond scum"}) == (0.0, 0)


def test_toxicity_odd_rows(spark):
    docs, marks = frame(spark), labels(spark)
    got = toxicity.toxicity(docs, marks)
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert toxicity.toxicity(docs.limit(0), marks).isEmpty()
    assert toxicity.toxicity(docs, marks.limit(0)).count() == docs.count()


def test_pipeline(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    whole = docs
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if at < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"out{at}"))
        docs = spark.read.parquet(str(tmp_path / f"out{at}"))
    assert docs.count() > 0 and whole.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_lexicon_keeps_both_kinds_of_an_entry_and_long_words():
    from wayhall.llm.toxicity import Lexicon, candidates, hits, word_before

    long_word = "abcdefghijklmnopqrstuvwxyzabcd"
    lexicon = Lexicon({"scum": 5.0, "scum*": 2.0, long_word: 3.0})
    auto = lexicon.machine()
    assert hits("scumbag", auto, set()) == (2.0, 1) and hits("scum", auto, set()) == (5.0, 1) and hits("a scum, scums", auto, set()) == (7.0, 2)
    assert long_word in candidates(f"x {long_word}") and hits(long_word, auto, set()) == (3.0, 1)
    text = "q" * 60 + " - scum"
    assert word_before(text, text.index("scum")) == "q" * 60 and hits(text, auto, {"q" * 60 + " scum"}) == (0.0, 0) and word_before("scum", 0) == ""
