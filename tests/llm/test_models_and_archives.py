import base64
import gzip
import hashlib
import io
import math
import zlib

import pytest

from tessitura.llm import toxicity, warc

from .conftest import words


def page_rows():
    return [(5, "http://a.example/x?q=1#f", "<p>eins</p>"), (3, "http://a.example/y", "<p>zwei</p>"), (9, None, "<p>eins</p>"), (7, "http://b.example", "<p>eins</p>"), (1, "bad url\r\nX: y", None), (2, "http://c.example/ü", ""), (4, "u", "é" * 5000), (4, "u", "é" * 5000)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in page_rows()], "page_id long, url string, html string, digest string, salt int")
    got = sorted((tuple(r) for r in warc.capture_digests(pages).collect()), key=repr)
    first: dict = {}
    for i, _, h in sorted(page_rows(), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    wanted = []
    for i, _, h in page_rows():
        body, of = (h or "").encode(), first[h or ""]
        wanted.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if of == i else "revisit", None if of == i else of))
    assert got == sorted(wanted, key=repr)


def test_nested_rows(spark, tmp_path):
    pages = spark.createDataFrame(page_rows()[:3], "page_id long, url string, html string")
    files = warc.write_archives(pages, str(tmp_path / "w"))
    rows = {r.metadata.page_id: r for r in warc.assemble(warc.read_archives(files, str(tmp_path / "w"), keep_payload=True)).collect()}
    assert bytes(rows[5].response.payload) == b"<p>eins</p>" and rows[5].response.target_uri == "http://a.example/x?q=1#f"
    assert rows[9].response.type == "revisit" and rows[9].response.payload is None and rows[9].metadata.refers_to == 5
    assert rows[3].request.target_uri == "http://a.example/y"


def test_revisits_name_what_they_repeat(spark):
    revisit = next(warc.parse_records(io.BytesIO(warc.transaction(9, "u", b"x", 5, "1970-01-01T00:00:00Z", "http://a/\r")[1])))[0]
    assert revisit["warc-type"] == "revisit" and revisit["warc-refers-to-target-uri"] == "http://a/%0D" and revisit["warc-refers-to-date"] == "1970-01-01T00:00:00Z"
    empty = spark.createDataFrame([(None, "u", "x")], "page_id long, url string, html string")
    assert warc.capture_digests(empty).count() == 0


def test_short_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert {r.page_id: r.record_type for r in warc.capture_digests(pages, least_bytes=3).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_damage_is_found():
    records = warc.transaction(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    packed = b"".join(gzip.compress(r) for r in records)
    kinds = [f["warc-type"] for f, _ in warc.parse_records(io.BytesIO(packed))]
    assert kinds == ["request", "response", "metadata"] and kinds == [f["warc-type"] for f, _ in warc.parse_records(io.BytesIO(b"".join(records)))]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.parse_records(io.BytesIO(packed[: len(packed) // 2] + b"\x00" * 40)))


def toxic_rows(n, seed):
    """Every third text has one of two insults, in its own spelling or, for the last ones, misspelt."""
    rows, labels = [], []
    for k in range(n):
        text = words(seed + k, 40, 400)
        toxic = k % 3 == 0
        if toxic:
            text[k % 40] = ("blatherskite", "nincompoop")[k % 2]
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity(make, spark):
    rows, labels = toxic_rows(400, 1000)
    extra = [(1000, " ".join([*words(1, 20, 400), "blatherskyte", *words(2, 20, 400)])), (1001, None), (1002, ""), (1003, " ".join(words(3, 20000, 400)))]
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(make([*rows, *extra, (None, "x")]), marks).collect()}
    assert set(got) == {i for i, _ in [*rows, *extra]}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i].held_out} == {*held, *(i for i, _ in extra if zlib.crc32(str(i).encode()) % 4 == 2)}
    right = sum(got[i].predicted == int(i % 3 == 0) for i in held)
    assert right / len(held) > 0.95
    assert got[1000].score > got[1001].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[1003].predicted == 0


def test_toxicity_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(make([(1, "a"), (2, None)]), none).collect()} == {0}
    assert toxicity.score(make([]), none).count() == 0


def gain_by_hand(model, word):
    """The mean of a word's gram vectors in plain Python: grams of 3 to 5 bytes with the word's edges, and the whole word."""
    flat, mask = b"<" + word + b">", (1 << 64) - 1
    values = []
    for k in (3, 4, 5):
        for i in range(len(flat) - k + 1):
            h = flat[i] + 1
            for c in flat[i + 1 : i + k]:
                h = (h * 0x100000001B3 + c) & mask
            values.append((h + k) & mask)
    values.append(sum(c * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i, c in enumerate(flat)) & mask)
    places = [((((v ^ (v >> 29)) * 0xBF58476D1CE4E5B9) & mask) >> 40) & (toxicity.BUCKETS - 1) for v in values]
    return sum(model.gains[p] for p in places) / len(places)


def test_scores_by_hand():
    rows, labels = toxic_rows(60, 77)
    model = toxicity.train([t.encode() for _, t in rows], [x for *_, x in labels])
    for text in (b"", b"a", b"one two", "drei vier fünf sechs".encode(), rows[0][1].encode(), rows[1][1].encode()):
        g = [gain_by_hand(model, w) for w in text.split()]
        best = max((sum(g[i : i + 2]) / 2 for i in range(len(g) - 1)), default=g[0] if g else 0.0)
        assert model.score(text.split()) == pytest.approx(1 / (1 + math.exp(-best - model.bias)), abs=1e-9)


def test_held_out_labels_are_not_seen(make):
    rows, labels = toxic_rows(60, 41)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    docs = make(rows)
    scores = [sorted(map(tuple, toxicity.score(docs, docs.sparkSession.createDataFrame(x, schema)).collect())) for x in (labels, flipped)]
    assert flipped != labels and scores[0] == scores[1]


def test_long_texts_train_too(make, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 10)
    rows, labels = toxic_rows(60, 41)
    docs = make([*rows, rows[0], (None, "x")])
    spark = docs.sparkSession
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 61 and len({r.score for r in got}) > 10
    monkeypatch.setattr(toxicity, "TRAIN_TOTAL", 0)  # one text of either kind stays
    assert toxicity.drawn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 2
