import random

from pyspark.sql import functions as F

import corpus_pipeline
from docflow.llm import queries


def test_stages(spark, tmp_path):
    r = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    item = say(30)
    good = [say(80) for _ in range(6)]
    rows = [(i, t, "en", "a") for i, t in enumerate(good)] + [(10, good[0], "en", "a"), (11, good[1] + " end", "en", "a"), (12, say(40) + " " + item + " " + say(40), "fr", "b"), (13, "%% ## " * 100, "en", "b"), (14, "too short", "en", "b"), (15, None, None, None)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    left = stages["quality_rules"](spark, docs, str(tmp_path))
    assert left.columns == docs.columns and {x["doc_id"] for x in left.collect()} == {0, 1, 2, 3, 4, 5, 10, 11, 12}
    left = stages["minhash_near_dedup"](spark, left, str(tmp_path))
    assert left.columns == docs.columns and {x["doc_id"] for x in left.collect()} == {0, 1, 2, 3, 4, 5, 12}
    left = stages["decontaminate"](spark, left, str(tmp_path))
    assert left.columns == docs.columns and {x["doc_id"] for x in left.collect()} == {0, 1, 2, 3, 4, 5}
    left = stages["mix_sources"](spark, left, str(tmp_path))
    assert left.columns == docs.columns and left.count() == 6  # one cell: everything has probability 1
    out = stages["token_store"](spark, left, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 6
    assert out.agg(F.max(F.col("start") + F.col("n_tokens")) == F.sum("n_tokens")).first()[0]


def test_stages_work_by_row(spark, tmp_path):
    r = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    a, b, c, d, e, f, item = say(80), say(80), say(80), say(80), say(80), say(80), say(30)
    rows = [(7, a), (7, a), (9, a), (9, b), (9, c + " end"), (10, c), (None, d), (None, d), (None, e), (11, f), (11, item + " " + say(40)), (None, item + " " + say(40))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    left = stages["minhash_near_dedup"](spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(((x["doc_id"], x["text"]) for x in left.collect()), key=str) == sorted([(7, a), (9, b), (9, c + " end"), (None, d), (None, e), *rows[9:]], key=str)
    for name in ("decontaminate", "mix_sources"):
        left = stages[name](spark, left, str(tmp_path))
        assert left.columns == docs.columns and sorted(((x["doc_id"], x["text"]) for x in left.collect()), key=str) == sorted([(7, a), (9, b), (9, c + " end"), (None, d), (None, e), (11, f)], key=str)
    assert stages["token_store"](spark, left, str(tmp_path)).count() == 6


def test_empty_tables_clashing_names_and_texts_without_words(spark, tmp_path):
    spark.createDataFrame([(1, "a question of a few words that is asked nowhere else")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = "doc_id long, text string, lang string, source string, n_chars long, _row string, component_id long, _quality_measurements int, n_tokens int, probability int, row int, hash int, kind string"
    extra = ("r", 1, 2, 3, 4, 5, 6, "k")
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    r = random.Random(7)
    text = " ".join(r.choice(words) for _ in range(90))
    rows = [(1, text, "en", "a", 5, *extra), (2, text + " end", "en", "a", 5, *extra), (3, None, None, None, None, *extra), (4, "", "en", "a", 0, *extra)]
    docs, stages = spark.createDataFrame(rows, names), corpus_pipeline.STAGES
    for name, stage in stages[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.columns == docs.columns and all(tuple(x)[5:] == extra for x in left.collect()), name
        assert {x["doc_id"] for x in left.collect()} == ({1, 2} if name == "quality_rules" else {1, 3, 4} if "dedup" in name else {1, 2, 3, 4}), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    out = {x["doc_id"]: x["n_tokens"] for x in stages[-1][1](spark, docs, str(tmp_path)).collect()}
    assert out[3] == out[4] == 1 and len(out) == 4 and stages[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
