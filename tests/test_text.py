import pytest
from pyspark.sql import functions as F

from tessitura.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Строка один\nПрипев:\nПрипев 2: *2\nПрипев:*3\nПроигрыш\nСтрока два", "Строка один\nСтрока два"),
        ("Припев: и снова в путь", "и снова в путь"),
        ("Майк: сегодня он здесь\nБоб: а я там\nОна сказала: нет", "сегодня он здесь\nа я там\nОна сказала: нет"),
        ("мы здесь ( 2 раза )\nне надо - 2раза\nи так далее (и т.д.)\nещё раз (2 раза)", "мы здесь\nне надо\nи так далее\nещё раз"),
        ("Меpтвые нe тлеют", "Мертвые не тлеют"),
        ("Rock'n'roll и E-95", "Rock'n'roll и E-95"),
        ("играй рок-n-ролл", "играй рок-н-ролл"),
        ("Мы споём этот припев вдвоём", "Мы споём этот припев вдвоём"),
        ("Припев (2 раза):\n[Припев]\n[Припев]:\nПрипев.\nПРИПЕВ( Уматурман):\nПрипев (2 раза).", ""),
    ],
)
def test_clean_text(spark, given, wanted):
    assert one(spark, T.clean_text(F.lit(given))) == wanted


def test_words_and_lemmas(spark):
    assert [one(spark, T.is_word(F.lit(w))) for w in ("кто-то", "Rock'n'roll", "—", "1987", "...")] == [True, True, False, False, False]
    assert one(spark, T.normalize_lemma(F.lit("Ещё"))) == "еще"
    assert one(spark, T.letters_only(F.lit("Ёлки — палки;\nКто-то «там»…"))) == "елки палки кто то там"
    assert one(spark, T.lower_line_initials(F.lit("А снег идёт\nИван пришёл\n— И что?"), ["Иван"])) == "а снег идёт\nИван пришёл\n— и что?"


def test_titles(spark):
    key = lambda s: one(spark, T.title_key(F.lit(s)))
    assert key("Ария Мистера X") == key("ария мистера Х")
    assert key("Ёлка...") == key("елка") and key("Кто я?") == key("кто я")
    assert one(spark, T.word_title_key(F.lit("Время и стекло"))) == "время стекло"
    assert one(spark, T.loose_title_key(F.lit("Кто — я?!"))) == "кто я"


@pytest.mark.parametrize(
    ("lyricist", "credit", "surname", "default", "wanted"),
    [
        ("К.Кинчев, А.Шаталин - К.Кинчев", "", "Кинчев", True, False),
        ("К.Кинчев, П.Самойлов", "", "Кинчев", True, False),
        ("Е.Летов/К.Уо", "", "Летов", True, False),
        ("", "К.Кинчев", "Кинчев", False, True),
        ("", "В.Задерий", "Кинчев", True, False),
        ("", "", "Кинчев", True, True),
        ("", "", "Кинчев", False, False),
        ("", "Шевчук Ю. - вокал, ак. гитара, автор", "Шевчук", False, True),
        ("Е.Летов-К.Рябинов", "", "Летов", True, False),
        ("Е. Летов — О. Судаков", "", "Летов", True, False),
    ],
)
def test_resolve_author(spark, lyricist, credit, surname, default, wanted):
    assert one(spark, T.resolve_author(F.lit(lyricist), F.lit(credit), F.lit(surname), F.lit(default))) is wanted


def test_filters(spark):
    for text in ("", "(инструментал)", "Инструментальная композиция", "(текст временно отсутствует)", "-"):
        assert one(spark, T.is_instrumental(F.lit(text)))
    assert not one(spark, T.is_instrumental(F.lit("раз два три четыре пять шесть семь восемь девять десять")))
    assert one(spark, T.is_foreign(F.lit("All the lonely people\nwhere do they all")))
    assert not one(spark, T.is_foreign(F.lit("Мы любим слушать громкий rock'n'roll по вечерам в пятницу")))
    assert one(spark, T.normalize_person(F.lit("И.Кормильцев"))) == "И. Кормильцев"
    assert one(spark, T.normalize_person(F.lit(" Е.Летов "))) == "Е. Летов"


def test_years_and_buckets(spark):
    assert [one(spark, T.decade(F.lit(y))) for y in (1987, 1990, 2026)] == ["1980-е", "1990-е", "2020-е"]
    assert [one(spark, T.length_bucket(F.lit(n))) for n in (0, 79, 80, 160, 161)] == ["<80", "<80", "80-160", "80-160", ">160"]
    assert [one(spark, T.to_year(F.lit(v))) for v in ("1984", " 1984 ", "ок. 1984", "")] == [1984, 1984, None, None]
    assert [one(spark, T.date_year(F.lit(v))) for v in ("1986, весна", "весна 1986")] == [1986, None]


def test_unknown_groups(spark):
    rows = spark.createDataFrame([(0, "a:X"), (1, "a:unknown"), (2, "a:X"), (3, "a:unknown"), (4, "b:unknown")], "i int, g string")
    got = [r.g for r in rows.select("i", T.split_unknown_groups(F.col("g"), F.col("i")).alias("g")).orderBy("i").collect()]
    assert got == ["a:X", "a:unknown#1", "a:X", "a:unknown#3", "b:unknown#4"]
