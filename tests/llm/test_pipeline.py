"""The stages against plain Python on a small folder of tables."""

import re

import corpus_pipeline
from tessitura.llm import toxicity

from .test_joins import groups
from .test_models_and_archives import toxic_rows
from .test_scans import alnum


def test_stages(spark, tmp_path):
    rows, labels = toxic_rows(90, 5000)
    shared = "this line stands in many texts of the corpus word for word"
    rows = [(i, t + "\n" + shared) for i, t in rows]
    rows += [(200, rows[1][1]), (201, " ".join(["z", *rows[2][1].split()[1:40]])), (202, "bench " + " ".join(f"t{k}" for k in range(12))), (203, None), (204, "")]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"t{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "packing"]

    clean = stages["toxicity"](spark, docs, folder)
    bad = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - bad and bad

    lines = stages["line_dedup"](spark, docs, folder)
    kept = {r.doc_id: r.text for r in lines.collect()}
    assert lines.columns == docs.columns and sum(shared in (t or "") for t in kept.values()) == 1
    assert 200 not in kept and kept[203] is None and kept[204] == ""
    assert all(r.n_chars == len(r.text or "") for r in lines.collect())

    single = stages["ngram_join"](spark, docs, folder)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in groups(rows).items() if i == c}

    fresh = stages["decontaminate"](spark, docs, folder)
    window = " ".join(f"t{k}" for k in range(10))
    assert {r.doc_id for r in fresh.collect()} == {i for i, t in rows if not re.search(window, " ".join(alnum(t)))}

    packed = corpus_pipeline.run(spark, folder)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert 202 not in {r.doc_id for r in packed.collect()}
