import os

import corpus_pipeline
from frameflow.llm.common import scratch, shared_dir
from frameflow.llm.dac import round_trip
from frameflow.llm.jaccard import jaccard_components
from frameflow.llm.quality import judge
from frameflow.llm.search import rank
from frameflow.llm.secrets import all_spans
from frameflow.llm.simhash import near_copies


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    prose = "Morning light fell over the quiet harbour while two fishermen mended their nets and spoke of storms"
    item = "Which of the following towers stands at the mouth of the northern river near the old mill and the bridge"
    rows = [
        (0, prose + " all day.", "en", "s", 1),
        (1, prose + " all day.", "en", "s", 1),
        (2, "So. " + item + " today", "en", "s", 1),
        (3, 'Keys: token = "abcdefgh12345" and so on, said the guard at the gate.', "en", "s", 1),
        (4, "12345 !!!", "en", "s", 1),
        (5, None, "en", "s", 1),
        (6, "Ein Haus am See mit einem Garten und vielen alten Apfelbäumen davor.", "de", "s", 1),
    ] + [(10 + i, f"filler number {i} about matter {i * 7} and place {i * 13} in time {i * i}", "en", "t", 1) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    everyone = {r[0] for r in rows}
    assert ids["language_id"] == everyone - {4, 5}
    assert ids["ngram_jaccard_join"] == everyone - {4, 5, 1}
    assert ids["benchmark_decontamination"] == ids["secret_scans"] == everyone - {4, 5, 1, 2}
    kept = {r.doc_id: r for r in docs.collect()}
    assert "abcdefgh12345" not in kept[3].text and all_spans(kept[3].text)[1] == [] and kept[3].n_chars == len(kept[3].text)
    before = set(os.listdir(shared_dir(spark)))
    with scratch(spark):
        packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert [t.split("-")[0] for t in set(os.listdir(shared_dir(spark))) - before] == ["secret_scans"]
    assert {r.doc_id for r in packed} == everyone - {4, 5, 1, 2}
    assert set(os.listdir(shared_dir(spark))) == before


def test_operators_leave_no_table_behind(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} some words that {i} documents share and no more than that", "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, "words that documents share")], "item_id long, text string")
    before = set(os.listdir(shared_dir(spark)))
    for run in (lambda: jaccard_components(docs), lambda: judge(docs, labels), lambda: round_trip(docs), lambda: rank(docs, items), lambda: near_copies(docs)):
        with scratch(spark):
            assert run().count() > 0
        assert set(os.listdir(shared_dir(spark))) == before


def test_pipeline_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = "which of the following towers stands at the mouth of the northern river near the old mill"
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    prose = "morning light fell over the quiet harbour while two fishermen mended their nets and spoke of storms"
    tables = {
        "empty": ([], set()),
        "unlabelled": ([(None, prose, None, None, None), (None, prose, None, None, None), (7, prose + " again", None, "s", 1), (8, "漢字", None, "s", 1), (9, "", None, "s", 0)], {7, 8}),
    }
    for name, (rows, want) in tables.items():
        folder = tmp_path / name
        folder.mkdir()
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(folder / "benchmark.parquet"))
        assert {r.doc_id for r in corpus_pipeline.run(spark, str(folder)).collect()} == want
