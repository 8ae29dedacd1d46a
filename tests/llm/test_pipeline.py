"""The pipeline's stages take effect, one upon the other."""

import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    words = {"en": "the and with that house river under water stone bridge".split(), "fr": "le les avec dans maison rivière été garçon pierre pont".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randrange(90)) for _ in range(n))
    item = text("en", 50)
    rows = [(i, text(lang := rng.choice(["en", "fr"]), rng.randrange(60, 200)), lang, f"s{i % 3}") for i in range(120)]
    rows += [(200, rows[5][1], "en", "s1"), (201, rows[7][1] + " tail", "en", "s1"), (202, "1234 5678", None, "s0"), (203, text("en", 80) + " " + item, "en", "s0"), (204, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mix", "token_output"]
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
        if name != "token_output":
            assert now.columns == docs.columns
    assert seen[0] == {r[0] for r in rows} - {202, 204}
    assert seen[1] == seen[0] - {200, 201}
    assert seen[2] == seen[1] - {203}
    assert seen[3] <= seen[2] and seen[4] == seen[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_stages_on_odd_and_no_rows(spark, tmp_path):
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, " \n\t ", "en", None), (3, "the and with that", "en", "a"), (3, "the and with that", "en", "a"), (None, "the and with this", "en", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "the and with that house")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema), spark.createDataFrame([], schema)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            count = now.count()
            assert count <= 3 * len(rows) and (name == "token_output" or now.columns == table.columns)
