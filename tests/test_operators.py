import math

import pytest
from pyspark.sql import functions as F

from tessitura.operators import corpus, evaluation, features, lexicon, sampling
from tessitura.sources import html, readers, sinks
from tessitura.streaming import dictionary


def token_rows(spark, texts, tags=None):
    """texts: {author: [[lemma, ...], ...]}"""
    rows, doc = [], 0
    for author, docs in texts.items():
        for d, words in enumerate(docs):
            rows += [(author, doc, i, w, tags[d][i] if tags else "NOUN") for i, w in enumerate(words)]
            doc += 1
    return spark.createDataFrame(rows, "author string, doc_id long, pos int, lemma string, tag string")


def test_frequency(spark):
    table = {r.lemma: r for r in lexicon.frequency_table(token_rows(spark, {"a": [["ночь"] * 3 + ["город"], ["город", "спать"]]})).collect()}
    assert (table["ночь"].f, table["ночь"].df, table["город"].f, table["город"].df) == (3, 1, 2, 2)
    assert table["спать"].ipm == pytest.approx(1e6 / 6)
    ranked = lexicon.frequency_table(token_rows(spark, {"a": [list("аааб"), list("бвв"), ["в"]]})).orderBy("rank").collect()
    assert [r.lemma for r in ranked] == ["в", "б", "а"]
    one = lexicon.frequency_table(token_rows(spark, {"a": [["на"] * 3]}, [["ADP", "ADP", "NOUN"]])).first()
    assert (one.tag, one.f, one.ipm, one.df, one.function) == ("ADP", 3, 1e6, 1, True)
    tags = [["ADV", "VERB", "VERB", "NOUN"]]
    flags = {r.lemma: r.function for r in lexicon.frequency_table(token_rows(spark, {"a": [["так", "нет", "быть", "небо"]]}, tags)).collect()}
    assert flags == {"так": True, "нет": True, "быть": True, "небо": False}


def test_keyness_formulas(spark):
    def z(f, n, rest, n_rest, prior, n_prior, a0):
        return spark.range(1).select(lexicon.log_odds_z(*(F.lit(float(x)) for x in (f, n, rest, n_rest, prior, n_prior, a0))).alias("z")).first().z

    yt, yr = 20 + 60 * 50 / 300, 30 + 60 * 50 / 300
    wanted = (math.log(yt / (160 - yt)) - math.log(yr / (260 - yr))) / math.sqrt(1 / yt + 1 / yr)
    assert z(20, 100, 30, 200, 50, 300, 60) == pytest.approx(wanted)
    assert z(30, 100, 10, 100, 40, 200, 50) == pytest.approx(-z(10, 100, 30, 100, 40, 200, 50)) and z(30, 100, 10, 100, 40, 200, 50) > 0
    assert z(5, 100, 50, 1000, 55, 1100, 50) == pytest.approx(0)

    def g(f, n, rest, n_rest):
        return spark.range(1).select(lexicon.dunning_g2(*(F.lit(float(x)) for x in (f, n, rest, n_rest))).alias("g")).first().g

    assert g(30, 100, 10, 100) > 0 > g(70, 100, 90, 100) and g(5, 10, 50, 100) == pytest.approx(0) and g(5, 10, 0, 0) is None


def test_unique(spark):
    words = token_rows(spark, {"A": [["небо", "небо", "город"], ["небо", "река"], ["опечатка"]], "B": [["город"], ["город", "поле"], ["поле", "ибо"], ["ибо"]]})
    function = spark.createDataFrame([("ибо",)], "lemma string")
    got = {(r.author, r.lemma): (r.df, r.f) for r in lexicon.unique_lemmas(lexicon.counts(words), function).collect()}
    assert got == {("A", "небо"): (2, 3), ("B", "поле"): (2, 2)}
    ranked = lexicon.unique_lemmas(lexicon.counts(token_rows(spark, {"A": [list("xyyz"), list("xyz"), list("xzz")], "B": [["q"]]})), function)
    assert [r.lemma for r in ranked.orderBy("rank").collect()] == ["z", "x", "y"]


def test_richness(spark):
    assert sampling.ttr(token_rows(spark, {"a": [list("абав")]})).first().ttr == 0.75
    assert [r.types for r in sampling.growth_curve(token_rows(spark, {"a": [list("abacb")]})).orderBy("n").collect()] == [1, 2, 2, 3, 3]
    three = token_rows(spark, {"a": [list("abc"), list("def"), list("ghi")]})
    sizes = sampling.sample_runs(three, 7, 4).groupBy("rep", "doc_id").count().groupBy("rep").agg(F.array_sort(F.collect_list("count")).alias("s")).collect()
    assert [r.s for r in sizes] == [[1, 3, 3]] * 4
    assert sampling.sample_runs(three, 10, 2).count() == 0
    fixed = sampling.sampled_ttr(token_rows(spark, {"a": [list("ab"), list("cd")]}), 4, 5).first()
    assert (fixed.ttr_mean, fixed.ttr_std) == (1.0, 0.0)
    drawn = sampling.sampled_ttr(token_rows(spark, {"a": [list("aa"), list("bc"), list("dd"), list("ef")]}), 2, 200).first()
    assert abs(drawn.ttr_mean - 0.75) < 0.1 and abs(drawn.ttr_std - 0.25) < 0.04
    points = spark.range(1, 2000).select(F.lit("a").alias("author"), F.col("id").alias("n"), (7 * F.pow("id", F.lit(0.6))).alias("types"))
    fit = sampling.heaps_fit(points).first()
    assert (fit.heaps_k, fit.heaps_beta, fit.heaps_r2) == (pytest.approx(7), pytest.approx(0.6), pytest.approx(1))
    both = sampling.sampled_unique(token_rows(spark, {"A": [["a1", "общее"]] * 4, "B": [["b1", "общее"]] * 2}), spark.createDataFrame([], "lemma string"), 4, 3)
    assert {r.author: (r.unique_mean, r.unique_std) for r in both.collect()} == {"A": (1.0, 0.0), "B": (1.0, 0.0)}


def test_chronology(spark):
    lex = spark.createDataFrame([("x", "бог")], "lexicon string, lemma string")
    hits = lexicon.lexicon_hits(token_rows(spark, {"a": [["бог", "и", "я", "мы"], ["мы", "и", "они", "вы"]]}), lex, "author")
    rate = lexicon.lexicon_rates(hits, "author").first()
    assert (rate.per_1000, rate.share) == (125.0, 0.5)
    twice = [sampling.bootstrap_interval(hits, ["author", "lexicon"], 200).first() for _ in range(2)]
    assert twice[0] == twice[1] and twice[0].low <= 125 <= twice[0].high


def test_merge(spark):
    schema = "key string, title string, album string, rank int, ordinal long, accepted boolean"
    rows = spark.createDataFrame([("k", "t", "A", 0, 0, True), ("k", "t", "B", 1, 1, False), ("m", "t", "Live", 2, 2, True), ("m", "t", "Studio", 0, 3, True)], schema)
    got = corpus.merge_versions(rows, ["key"], ["title"]).collect()
    assert [(r.key, r.album, r.albums) for r in got] == [("m", "Studio", ["Live", "Studio"])]
    titles = spark.createDataFrame([("", "Песня", "Концерт", 2, 0, True), ("", "песня...", "Студийный", 0, 1, True), ("", "Другая", "Концерт", 2, 2, True)], schema)
    assert sorted(r.albums for r in corpus.dedupe_versions(titles, "title", ["ordinal"]).collect()) == [["Концерт"], ["Концерт", "Студийный"]]


def test_build_corpus(spark):
    words = "раз два три четыре пять шесть семь восемь"
    song = "artist string, ordinal long, title string, album string, credit string, lyricist string, text string, url string"
    songs = spark.createDataFrame([("x", 0, "Первая песня!", "Поздний концерт", "", "", words, "u0"), ("x", 1, "Чужая", "Альбом", "", "", words, "u1"), ("x", 2, "Без слов", "Альбом", "", "", "-", "u2"), ("x", 3, "Вторая", "альбом.", "", "", words, "u3")], song)
    artists = spark.createDataFrame([("x", "Автор", "Автор", True, ["tribute"], False, "song")], "artist string, author string, surname string, default_to_main boolean, excluded_kinds array<string>, albums_must_be_known boolean, default_genre string")
    albums = spark.createDataFrame([("x", "Поздний концерт", "1999", "live", 0), ("x", "Альбом", "1985", "studio", 1)], "artist string, album string, year string, kind string, line long")
    empty = lambda s: spark.createDataFrame([], s)
    got = corpus.build_corpus(
        songs, artists, albums, empty("artist string, alias string, album string, line long"), spark.createDataFrame([("x", "чужая")], "artist string, title string"),
        empty("artist string, title string, year string, line long"), empty("artist string, title string, kind string, line long"),
        spark.createDataFrame([("x", "Первая песня", "Ранний альбом", "1982", 0)], "artist string, title string, album string, year string, line long"),
    )
    rows = {r.title: r for r in got.collect()}
    assert set(rows) == {"Первая песня!", "Вторая"}
    first = rows["Первая песня!"]
    assert (first.album, first.year, first.group, first.albums) == ("Ранний альбом", 1982, "x:Ранний альбом", ["Поздний концерт"])
    assert (rows["Вторая"].year, rows["Вторая"].genre) == (1985, "song")


def test_features_and_delta(spark):
    vocabulary = spark.createDataFrame([("и",), ("в",)], "lemma string")
    rel = {(r.doc_id, r.lemma): r.rel for r in features.relative_frequencies(token_rows(spark, {"a": [["и", "и", "небо", "в"]]}), vocabulary).collect()}
    assert rel == {(0, "и"): 0.5, (0, "в"): 0.25}
    z = spark.createDataFrame([(0, "x", 1.0), (0, "y", -1.0), (1, "x", 0.0), (1, "y", 2.0)], "doc_id long, lemma string, z double")
    cent = spark.createDataFrame([("A", "x", 0.0), ("A", "y", 0.0), ("B", "x", 1.0), ("B", "y", 1.0)], "label string, lemma string, c double")
    assert {r.distance for r in features.delta_distances(z, cent).collect()} == {1.0}
    assert {r.predicted for r in features.delta_predict(features.delta_distances(z, cent)).collect()} == {"A"}
    grams = spark.range(1).select(features.char_wb_ngrams(F.lit("аб в")).alias("g")).first().g
    assert grams == [" а", "аб", "б ", " аб", "аб ", " аб ", " в", "в ", " в ", " в "] or set(grams) == {" а", "аб", "б ", " аб", "аб ", " аб ", " в", "в ", " в "}


def test_evaluation(spark):
    cells = [[9, 3, 1], [2, 7, 0], [0, 4, 5]]
    rows = [("ABC"[i], "ABC"[j]) for i in range(3) for j in range(3) for _ in range(cells[i][j])]
    got = evaluation.confused_pairs(evaluation.confusion(spark.createDataFrame(rows, "truth string, predicted string")), 2).collect()
    assert [(r.a, r.b, r.n) for r in got] == [("A", "B", 5), ("B", "C", 4)]
    buckets = spark.createDataFrame([("A", "A", 10), ("B", "B", 10), ("A", "B", 200), ("B", "A", 200)], "truth string, predicted string, n_tokens long")
    assert {r.bucket: (r.n, r.macro_f1) for r in evaluation.macro_f1_by_bucket(buckets).collect()} == {"<80": (2, 1.0), ">160": (2, 0.0)}
    coef = spark.createDataFrame([(lab, n, c) for lab, row in (("A", (0.5, -2.0, 1.5, 0.1)), ("B", (-1.0, 3.0, 0.0, 2.0))) for n, c in zip("wxyz", row, strict=True)], "label string, name string, coef double")
    top = [(r.label, r.name) for r in evaluation.top_coefficients(coef, 2).orderBy("label", "rank").collect()]
    assert top == [("A", "y"), ("A", "w"), ("B", "x"), ("B", "z")]


@pytest.mark.parametrize(
    ("known", "unknown", "threshold", "score"),
    [([0.6, 0.7, 0.8], [0.1, 0.2, 0.3], 0.6, 1.0), ([0.5, 0.9], [0.1, 0.2], 0.5, 1.0), ([0.9, 0.8, 0.2, 0.7], [0.1, 0.5], 0.7, 0.875)],
)
def test_openset(spark, known, unknown, threshold, score):
    rows = spark.createDataFrame([(s, True) for s in known] + [(s, False) for s in unknown], "score double, known boolean")
    best = evaluation.best_threshold(rows).first()
    assert (best.threshold, best.balanced_accuracy) == (threshold, pytest.approx(score))


def test_lookups(spark):
    rows = spark.createDataFrame([("a", "t", "c", "l"), ("a", "u", "c", "l"), ("b", "t", "c", "l")], "album string, title string, credit string, lyricist string")
    table = spark.createDataFrame([("a", "t", "c1", "l1"), ("a", "", "c2", "l2")], "album string, title string, credit string, lyricist string")
    got = {(r.album, r.title): (r.credit, r.lyricist) for r in corpus.two_level_lookup(rows, table, "album", "title", ["credit", "lyricist"]).collect()}
    assert got == {("a", "t"): ("c1", "l1"), ("a", "u"): ("c2", "l2"), ("b", "t"): ("c", "l")}
    titles = spark.createDataFrame([("время колокольчиков", 0), ("вечный пост", 1), ("в", 2)], "title string, o int")
    found = corpus.prefix_join(spark.createDataFrame([("вре",), ("в",)], "entry string"), titles, "entry", "title", "o").collect()
    assert {r.entry: r.title for r in found} == {"вре": "время колокольчиков", "в": "время колокольчиков"}


def test_pages():
    tree = html.parse('<html lang="ru"><title> A  b</title><body><p>one<br>two\nthree<p>four<script>x</script><!-- c --><a href="/u">lin&amp;k</a>')
    assert html.to_text(tree.find("body")) == "one\ntwo three\n\nfourlin&k"
    assert (html.title(tree), html.lang(tree), html.links(tree)) == ("A b", "ru", [{"href": "/u", "label": "lin&k"}])


def test_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# note\na\tb\n1\tx\n# more\n2\t\n", encoding="utf-8")
    rows = readers.tsv(spark, str(tmp_path / "t.tsv"), ["a", "b"]).orderBy("line").collect()
    assert [(r.a, r.b) for r in rows] == [("1", "x"), ("2", "")]
    assert readers.tsv(spark, str(tmp_path / "none.tsv"), ["a"]).count() == 0
    df = spark.createDataFrame([("p", 1.23456, ["u", "v"])], "author string, z double, w array<string>")
    sinks.tsv(df, str(tmp_path / "out"), by=["author"], formats={"z": 2})
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True, inferSchema=False).first().asDict() == {"z": "1.23", "w": "u v", "author": "p"}
    song = {k: "x" for k in ("source", "title", "album", "credit", "lyricist", "text", "url")}
    spark.createDataFrame([song]).write.json(str(tmp_path / "s"))
    assert readers.songs(spark, str(tmp_path / "s")).count() == 1
    spark.createDataFrame([{"source": "x"}]).write.json(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="no field"):
        readers.songs(spark, str(tmp_path / "bad")).collect()


def test_align(spark):
    tokens = spark.createDataFrame([(1, "a", "t")], "id int, author string, title string")
    good = spark.createDataFrame([(1, "a", "t", "x")], "id int, author string, title string, text string")
    assert readers.align(tokens, good, "id").first().text == "x"
    with pytest.raises(Exception, match="match"):
        readers.align(tokens, spark.createDataFrame([(1, "a", "u", "x")], "id int, author string, title string, text string"), "id").collect()


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 01:00:00", "Да да"), ("2024-01-02 01:00:00", "да")], "ts string, said string").select(F.col("ts").cast("timestamp").alias("ts"), "said")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = dictionary.windowed_counts(stream, "ts", "said").writeStream.outputMode("complete").format("memory").queryName("dictionary_test").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.f for r in spark.table("dictionary_test").collect()) == [1, 2]
