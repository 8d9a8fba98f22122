import corpus_pipeline
from embervane.llm import toxicity
from pyspark.sql import functions as F


def test_stages_keep_the_clean_and_drop_the_rest(spark, docs_of, prose, tmp_path):
    item = prose("item", 30)
    rows = [(i, prose(i, 80)) for i in range(40)]
    rows += [(100 + i, f"{prose(500 + i, 40)} snortle {prose(600 + i, 9)} grumblefig") for i in range(60)]
    rows += [(200, rows[3][1]), (201, rows[3][1] + " more"), (300, f"{prose(900, 40)} {item} {prose(901, 40)}"), (400, f"{prose(902, 30)} password=zz91yy82xx73ww64 {prose(903, 20)}"), (500, None), (501, "")]
    d = str(tmp_path / "sf")
    docs_of(rows, clash=False).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in rows if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert set(seen["toxicity"]) == {i for i, _ in rows if not 100 <= i < 200}
    assert set(seen["toxicity"]) - set(seen["near_duplicates"]) == {200, 201}
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {300}
    assert set(seen["decontamination"]) == set(seen["secrets"]) == set(seen["byte_bpe"])
    assert "zz91" not in seen["secrets"][400].text and seen["secrets"][400].n_chars == len(seen["secrets"][400].text)
    assert all(seen["byte_bpe"][i].decoded == (seen["secrets"][i].text or "") for i in seen["secrets"])
    assert toxicity and F and corpus_pipeline.run(spark, d).count() == len(seen["byte_bpe"])


def test_repeated_rows_and_empty_documents(spark, docs_of, prose, tmp_path):
    d = str(tmp_path / "sf")
    rows = [(1, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50)), (None, prose(3, 50))]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, prose("i", 20))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs_of(rows, clash=False).write.parquet(f"{d}/documents.parquet")
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.run(spark, d).collect()) == [-1, 1, 2]
    e = str(tmp_path / "empty")
    docs_of(rows, clash=False).limit(0).write.parquet(f"{e}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(f"{e}/labels.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").limit(0).write.parquet(f"{e}/benchmark.parquet")
    assert corpus_pipeline.run(spark, e).count() == 0


def test_rows_without_an_id_pass_the_near_duplicates(spark, docs_of, prose):
    """Whether or not an id repeats elsewhere."""
    a, b = prose(1, 50), prose(2, 50)
    for rows in ([(None, a), (None, a), (1, b), (2, b), (3, a)], [(None, a), (None, a), (1, b), (1, b), (2, b), (3, a)]):
        kept = corpus_pipeline.one_of_each_group(spark, docs_of(rows, clash=False), "").collect()
        assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(-1, a), (-1, a), (1, b), (3, a)])
