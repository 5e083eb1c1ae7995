"""Track lists, title indexes, dates, scrapes."""

from pyspark.sql import functions as F

from tessitura.sources import discography as D
from tessitura.sources import songs as S


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# note\ntitle\tlyricist\nПeсня!\tА\nпесня\tБ\n", encoding="utf-8")
    assert [tuple(r) for r in D.title_map(spark, str(tmp_path / "t.tsv"), "lyricist").collect()] == [("песня", "Б")]
    (tmp_path / "a.tsv").write_text("page\talbum\tyear\tkind\np1\tA\t1984\tstudio\np2\tB\t\tlive\n", encoding="utf-8")
    assert {(r.page, r.album, r.year, r.kind) for r in D.albums(spark, str(tmp_path / "a.tsv")).collect()} == {("p1", "A", 1984, "studio"), ("p2", "B", None, "live")}
    songs = spark.createDataFrame([("Песня.", "x"), ("Другая", "x"), (None, "x")], "title string, lyricist string")
    got = D.with_lyricist(songs, D.title_map(spark, str(tmp_path / "t.tsv"), "lyricist"), "Ц")
    assert {(r.title, r.lyricist) for r in got.collect()} == {("Песня.", "Б"), ("Другая", "Ц"), (None, "Ц")}


def test_kinds(spark):
    rows = spark.createDataFrame([("Синглы", "x"), ("нет", "x"), ("Сборники и Синглы", "Макси-Сингл"), ("Сборники и Синглы", "Лучшее"), (None, "x")], "section string, album string")
    got = [tuple(r) for r in rows.select(D.section_kind(F.col("section")), D.album_kind(F.col("section"), F.col("album"))).collect()]
    assert got == [("single", "studio"), ("other", "studio"), ("other", "single"), ("other", "compilation"), ("other", "studio")]


def test_track_lists(spark):
    page = "<p>1. Раз 3:15</p><p>нет</p><p>2 . <i>Два  три</i> (live)</p><h3>x</h3><p>3. Потом</p>"
    assert D.numbered_tracks(page) == ["Раз", "Два три"] and D.numbered_tracks("") == []
    pages = spark.createDataFrame([("u", page), ("v", None)], "url string, html string")
    assert [(r.url, r.ordinal, r.key) for r in D.track_lists(pages).collect()] == [("u", 0, "раз"), ("u", 1, "два три")]


def test_index_and_tracks(spark):
    links = spark.createDataFrame([(0, "Песня 2", "/song/a"), (1, "Песня (live)", "/song/b"), (2, "Happy", "/song/c"), (3, "x", "/other")], "ordinal int, text string, href string")
    index = D.title_index(links, "http://h/", r"^/song/[\w-]+$", {"happy": "хэппи"})
    targets = {r.key: r.target for r in index.collect()}
    assert targets["песня"] == "http://h/song/a" and targets["хэппи"] == "http://h/song/c" and "x" not in targets
    wanted = spark.createDataFrame([("A", "Песня (другая)"), ("A", "Хэппи"), ("B", "Нет"), ("B", "Симбол: песня")], "album string, title string")
    found = D.find_tracks(wanted, index)
    assert {r.title: r.target for r in found.collect()} == {"Песня (другая)": "http://h/song/a", "Хэппи": "http://h/song/c", "Нет": None, "Симбол: песня": None}
    pages = spark.createDataFrame([("http://h/song/a", "<div class='t'>раз<br>два</div>"), ("http://h/song/c", "<p>x</p>")], "url string, html string")
    assert [tuple(r) for r in D.songs_of_tracks(found, pages, "div.t", "s").collect()] == [("s", "Песня (другая)", "A", "раз\nдва", "http://h/song/a")]


def test_held_out(spark):
    rows = spark.createDataFrame([("Липкий пульс (remix)",), ("feat. SYMBOL",), ("Песня",), ("Симбoл",)], "t string")
    assert [r[0] for r in rows.select(D.is_held_out(F.col("t"))).collect()] == [True, True, False, True]


def test_dates(spark):
    page = "<p class='subtitle'>Раз</p><p>стр. 12, (*); 1984–1985. Ещё</p><p class='subtitle'>Два</p><p>без даты</p><p class='subtitle'>Три</p><p>стр. 3 весна 1986</p>"
    assert D.dated_titles(page) == [("Раз", "1984–1985", 1985), ("Три", "весна 1986", 1986)]
    chapters = spark.createDataFrame([("b", 0, "<h1>Стихи</h1>"), ("b", 1, "<h2>Комментарии</h2><p>x</p>"), ("b", 2, "<h2>Комментарии</h2>"), ("c", 0, None)], "path string, ordinal int, html string")
    assert [tuple(r) for r in D.commentary(chapters).collect()] == [("b", "<h2>Комментарии</h2><p>x</p>")]
    titles = spark.createDataFrame([("Ёлка и лес", 0), ("Когда мы шли домой", 1), ("Когда мы пели", 2)], "title string, ordinal int")
    entries = spark.createDataFrame([("елка, лес",), ("Ёлка и лес (вариант)",), ("«Когда мы...»",), ("Когда мы",)], "entry string")
    assert {r.entry: r.title for r in D.attach_titles(entries, titles).collect()} == {"елка, лес": "Ёлка и лес", "Ёлка и лес (вариант)": "Ёлка и лес", "«Когда мы...»": "Когда мы шли домой", "Когда мы": None}


def test_chord_grammars():
    assert S.is_chord_line("А") and not S.is_chord_line("А", S.LATIN_CHORD) and not S.is_chord_line("В С", S.PLAIN_CHORD)
    assert S.is_chord_line("Am C7 F#", S.LATIN_CHORD) and S.is_chord_line("A7+", S.LATIN_CHORD) and not S.is_chord_line("A7+", S.PLAIN_CHORD)
    assert S.has_inline_chords("слово Am слово") and not S.has_inline_chords("Am C") and not S.has_inline_chords("слово")


def test_edge_credit():
    assert S.edge_credit("слова — А. Б.\nраз\nдва") == ("раз\nдва", "слова — А. Б.", "А. Б.")
    assert S.edge_credit("раз\n(стихи: Иван Иванов, 1980)") == ("раз", "стихи: Иван Иванов, 1980", "Иван Иванов")
    assert S.edge_credit("раз\nслова А. Б.\nдва") == ("раз\nслова А. Б.\nдва", "", "")


def test_scrape(spark):
    pages = {"http://h/": "<a href='/1'>a</a><a href='/2'>b</a><a href='/1'>c</a>", "http://h/1": "<b>Песня</b><p>раз", "http://h/2": "<p>нет"}
    asked = []

    def fetch(urls):
        asked.append(urls)
        return spark.createDataFrame([(u, pages[u]) for u in urls], "url string, html string")

    songs, empty = D.scrape(["http://h/"], lambda page, url: S.index_links(page, url, r"^/\d"), fetch, "bold", "s")
    assert [(r.title, r.text, r.url) for r in songs.collect()] == [("Песня", "раз", "http://h/1")] and [r.url for r in empty.collect()] == ["http://h/2"]
    assert asked == [["http://h/"], ["http://h/1", "http://h/2"]]
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, n int")
    assert {tuple(r) for r in D.first_of_each(rows, ["k"], ["n"]).collect()} == {("a", 1), ("b", 3)}
