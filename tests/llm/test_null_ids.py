from playtide.llm import context_lm, language_id


def test_rows_without_an_id_train_and_are_not_held_out(spark, tmp_path):
    """Rows without an id are in no bucket: they train, and the queries return false for held_out."""
    rows = [(i, "the thing was here and there " * 5, "en") for i in range(8)] + [(None, "völlig andere wörter " * 9, "de"), (None, "völlig andere wörter " * 9, "de"), (None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = language_id.op2_language_id(spark, str(tmp_path))
    assert [(r.held_out, r.lang_pred) for r in found.filter("doc_id IS NULL").orderBy("lang_pred").collect()] == [(False, "de"), (False, "de"), (False, "und")]
    assert found.filter("held_out IS NULL").count() == 0
    scored = context_lm.op9_suffix_tree_lm(spark, str(tmp_path)).filter("doc_id IS NULL").orderBy("n_tokens").collect()
    assert [(r.held_out, r.n_tokens, r.n_known) for r in scored] == [(False, 1, 1), (False, 28, 28), (False, 28, 28)]
