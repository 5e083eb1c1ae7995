import pytest
from pyspark.sql import functions as F

from tessitura.operators import morphology


@pytest.mark.parametrize(
    ("form", "lemma", "tag", "parses", "wanted"),
    [
        ("их", "их", "DET", [("NPRO", "они", None)], "они"),
        ("ее", "ее", "DET", [], "она"),
        ("страшно", "страшный", "ADJ", [("PRED", "страшно", None)], "страшно"),
        ("сильней", "сильней", "ADJ", [("COMP", "сильный", None)], "сильный"),
        ("раскрытых", "раскрыть", "VERB", [("PRTF", "раскрыть", "раскрытый")], "раскрытый"),
        ("вязнут", "вязнуть", "VERB", [("VERB", "вязнуть", None)], "вязнуть"),
        ("горе", "горе", "NOUN", [("NOUN", "гора", None), ("NOUN", "горе", None)], "горе"),
        ("пошли", "пойти", "VERB", [("VERB", "пойти", None)], "пойти"),
        ("пошли", "пошли", "VERB", [("VERB", "пойти", None)], "пойти"),
        ("далью", "далья", "NOUN", [], "даль"),
    ],
)
def test_combine_lemma(spark, form, lemma, tag, parses, wanted):
    rows = spark.createDataFrame([(form, lemma, tag, parses)], "form string, lemma string, tag string, parses array<struct<pos: string, normal: string, participle: string>>")
    assert rows.select(morphology.combine_lemma(F.col("form"), F.col("lemma"), F.col("tag"), F.col("parses")).alias("x")).first().x == wanted


def test_lexicon_and_analyzer(spark):
    tokens = spark.createDataFrame([(1, 0, "Ещё"), (1, 1, "Слово")], "doc_id long, pos int, form string")
    lexicon = spark.createDataFrame([("ещё", "ADV", "еще")], "form string, tag string, lemma string")
    got = [(r.tag, r.lemma) for r in morphology.with_lexicon(tokens, lexicon).orderBy("pos").collect()]
    assert got == [("ADV", "еще"), ("X", "слово")]
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    halves = morphology.with_analyzer(docs, lambda: lambda t: (t.split(), ["X"] * len(t.split()), t.upper().split()))
    assert [(r.doc_id, r.lemmas) for r in halves.orderBy("doc_id").collect()] == [(1, ["A", "B"]), (2, [])]
    with pytest.raises(Exception, match="unequal"):
        morphology.with_analyzer(docs, lambda: lambda t: ([], ["X"], [])).collect()
