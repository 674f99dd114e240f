"""The pipeline: each stage against brute force on a small table, then all of it."""

import corpus_pipeline
from lodeframe.llm.queries import tokenizer_path
from lodeframe.storage import stored
from tokenizers import Tokenizer


def test_stages(spark, tmp_path):
    prose = lambda k, n=60: " ".join(f"w{k}x{j * 7919 % 1000}" for j in range(n))
    passage = prose(77, 30)
    rows = [(1, prose(1)), (2, prose(1)), (3, "again and again we say so " * 20), (4, prose(4) + " " + passage), (5, prose(5) + " mail me@here.org"), (6, "short"), (7, None), (8, prose(8) + " w8xnew")]
    documents = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == documents.columns
        kept[name] = sorted(r.doc_id for r in docs.collect())
    assert kept == {"quality_rules": [1, 2, 4, 5, 8], "near_duplicates": [1, 4, 5, 8], "decontamination": [1, 5, 8], "personal_data": [1, 5, 8]}
    texts = {r.doc_id: r for r in docs.collect()}
    assert texts[5].text.endswith("mail <email>") and texts[5].n_chars == len(texts[5].text)
    library = Tokenizer.from_file(tokenizer_path())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in packed) == [1, 5, 8]
    assert {r.doc_id: r.n_tokens for r in packed} == {i: len(library.encode(x.text, add_special_tokens=False).ids) + 1 for i, x in texts.items()}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns_and_no_ids(spark, odd, tmp_path):
    """Columns that the operators use inside, null ids and texts, repeated rows."""
    spark.createDataFrame([(1, "the cat sat on the mat and then it slept")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.selectExpr("*", "1L AS row", "'x' AS digest", "2L AS node", "0L AS n_chars", "'y' AS held", "3L AS __word")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        n = after.count()  # no text of the table has 20 words without repetition
        assert after.columns == docs.columns and (n == 0 if name == "quality_rules" else n > 0), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
