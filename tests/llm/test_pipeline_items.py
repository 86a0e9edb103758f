"""Short benchmark items in the decontamination stage of the pipeline."""

from pyspark.sql import functions as F

import corpus_pipeline


def test_short_items_remove_no_clean_documents(spark, docs, tmp_path):
    items = ["Yes", "42", "the old MAN, 's", "one two three four", "Five words are an item", " ".join(f"q{i}" for i in range(14)), "", None]
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["yes the old man said 42", "He said yes yes yes no", "ONE two three four and that is all there is", "but five words are an item here", " ".join(f"q{i}" for i in range(2, 13)), None, "clean"]
    kept = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs(texts), str(tmp_path)).collect()}
    assert kept == {0, 1, 2, 5, 6}


def test_documents_that_are_short_items_go(spark, docs, tmp_path):
    items = ["Yes", "42", "one two three four"]
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["Yes.", "yes, 42!", "One two three four; five", "one two three four five six", "yes and no", "no", "", None]
    kept = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs(texts).withColumn("n_hit", F.lit(3)), str(tmp_path)).collect()}
    assert kept == {3, 4, 5, 6, 7}


def test_passages_are_cut_out_of_the_text_as_written(spark, docs):
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [f"first line\n{passage}", f"\ta  b\n\n{passage}\n c\td \n", f"{passage} end\n", f"x\n{passage}", passage]
    rows = corpus_pipeline.substring_dedup(spark, docs(texts), "").orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == [texts[0], "\ta  b\n\nc\td \n", "end\n", "x\n"]
    assert [r["n_chars"] for r in rows] == [len(r["text"]) for r in rows]


def test_the_mix_keeps_the_documents(spark, docs):
    texts = ["a b c", "a b c", None, "d " * 40, "e"]
    frame = docs(texts, [1, 1, 2, 3, None]).withColumn("size", F.lit("old"))
    rows = corpus_pipeline.mixing_to_weights(spark, frame, "")
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "copies", "taken"]
    found = rows.collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in found) == sorted((str(i), str(t)) for i, t in zip([1, 1, 2, 3, None], texts))
    assert all(r["taken"] == r["copies"] * r["size"] for r in found)
