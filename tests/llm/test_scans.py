"""Operators that look at one text at a time, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessitura.llm import binary_records, decontaminate, licenses, packing, quality

from .conftest import words

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def oracle(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.execute(sql).fetchall(), key=repr)


def test_binary_records_round_trip(make, corpus, tmp_path):
    tokenizer, folder = Tokenizer.from_file(BYTE), str(tmp_path / "r")
    rows = [*corpus, (5, "a repeated id"), (None, "no id")]
    index = binary_records.write_records(make(rows), BYTE, 2, folder)
    wanted = sorted((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows if i is not None)
    got = sorted((r.doc_id, list(r.ids)) for r in binary_records.read_records(index, folder).collect())
    assert got == wanted
    digests = binary_records.record_digests(make(corpus), BYTE).orderBy("doc_id").collect()
    start = 0
    for r, (i, t) in zip(digests, sorted(corpus, key=lambda x: x[0]), strict=True):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_damaged_frames():
    good = binary_records.frame(b"payload")
    assert binary_records.unframe(good) == b"payload"
    for k in range(len(good)):
        with pytest.raises(ValueError):
            binary_records.unframe(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])


def test_packing(make, corpus):
    tokenizer = Tokenizer.from_file(WORD)
    got = by_id(packing.pack(make(corpus), WORD, 256, 1))
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in corpus}
    assert set(got) == set(ids)
    sequences = defaultdict(list)
    for i, pieces in got.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[i]), zlib.crc32(ids[i][at : at + p.length].tobytes()))
            at += p.length
            sequences[p.sequence_id].append((p.offset, p.length))
        assert at == len(ids[i])
    for pieces in sequences.values():
        ends = 0
        for offset, n in sorted(pieces):
            assert offset == ends
            ends += n
        assert ends & (ends - 1) == 0 and ends <= 256  # full, or a power of two


def test_packing_puts_likeness_together():
    docs = [np.array([k * 50 + j for j in range(40)]) for k in range(4)] * 2
    sequences = []
    packing.pack_shard(docs, 1000, 80, [], lambda pieces: sequences.append({d % 4 for d, _, _ in pieces}))
    assert len(sequences) == 4 and all(len(s) == 1 for s in sequences)


def test_packing_looks_up_all_terms():
    rare, shared = np.arange(24), np.arange(100, 200)
    docs = [np.concatenate([rare, shared]), *(np.array([t]) for t in rare), shared, *(np.array([t, 300]) for t in shared)]
    docs += [np.array([400 + k]) for k in range(40)]
    index = packing.Bm25Index(docs, 500)
    assert index.neighbours(index.terms[0], np.arange(len(docs)) == 0, 1).tolist() == [25]
    # Against plain BM25 over every term of the seed, rare and common.
    texts = [np.array([int(w[1:]) for w in words(k, 40, 60 + 400 * (k % 2))]) for k in range(80)]
    index, mean = packing.Bm25Index(texts, 500), sum(map(len, texts)) / 80
    df = Counter(t for x in texts for t in set(x.tolist()))
    for q in range(80):
        score = [sum(np.log1p((80 - df[t] + 0.5) / (df[t] + 0.5)) * (n := (x == t).sum()) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in set(texts[q].tolist())) for x in texts]
        got = index.neighbours(index.terms[q], np.arange(80) == q, 5)
        assert np.allclose([score[d] for d in got], sorted((s for d, s in enumerate(score) if d != q), reverse=True)[:5], rtol=1e-4)


def test_licenses(make, corpus):
    rows = [*corpus, (200, "Released under the GNU General Public License, or MIT-License; cc by CC BY"), (201, "the Apach License and the MIT licence"), (202, "permit license apachelicense"), (203, "aphache licence")]
    got = by_id(licenses.scan(make(rows)))
    for i, t in rows:
        w, starts, labels = alnum(t), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        r = got[i][0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[201][0].labels == "apache,mit" and got[201][0].base_labels == ""
    assert [(s.label, s.first_word, s.end_word, s.edits) for s in got[201][0].spans] == [("apache", 1, 3, 1), ("mit", 5, 7, 1)]
    assert got[202][0].labels == "apache" and got[203][0].labels == ""


def test_licenses_next_to_better_ones(make):
    text = "gnu generl public license then gnu general public license gnu genral public licens or mit licence mit license mt license"
    spans = by_id(licenses.scan(make([(1, text)])))[1][0].spans
    assert [(s.label, s.first_word, s.end_word, s.edits) for s in spans] == [("gpl", 0, 4, 1), ("gpl", 5, 9, 0), ("gpl", 9, 13, 2), ("mit", 14, 16, 1), ("mit", 16, 18, 0), ("mit", 18, 20, 1)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_license_spans_by_dynamic_programming(make):
    """Every place within the bound meets a span of its label, and every span is within the bound of a phrase of its label."""
    rng, letters, wanted = random.Random(5), "abcdefilnopst ", licenses.compiled(licenses.PHRASES, licenses.NOTICES)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(4):
            phrase = list(rng.choice(wanted).phrase.decode())
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(phrase))
                phrase[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
            parts += ["".join(phrase), " ".join("".join(rng.choices(letters[:-1], k=4)) for _ in range(rng.randrange(3)))]
        rows.append((i, " ".join(parts)))
    got = by_id(licenses.scan(make(rows)))
    for i, text in rows:
        own = alnum(text)
        spans = [(s.label, s.first_word, s.end_word, s.edits) for s in got[i][0].spans]
        for label, first, end, edits in spans:
            far = [(edit_distance(n.phrase.decode(), " ".join(own[first:end])), n.edits) for n in wanted if n.label == label]
            assert any(d <= edits <= bound for d, bound in far), (text, label, first, end)
        for n in wanted:
            phrase = n.phrase.decode()
            for first in range(len(own)):
                for end in range(first + 1, min(len(own), first + phrase.count(" ") + 3) + 1):
                    place = " ".join(own[first:end])
                    if abs(len(place) - len(phrase)) <= n.edits and edit_distance(phrase, place) <= n.edits:
                        assert any(label == n.label and a < end and first < b for label, a, b, _ in spans), (text, phrase, place)


def test_own_notices_leave_the_base_alone(make):
    text = "Licensed under the Mozilla Public Licence; SPDX-License-Identifier: x. Redistribution and use in source and binary forms"
    r = by_id(licenses.scan(make([(1, text), (2, None), (3, "no notice"), (3, "no notice")])))
    assert (r[1][0].labels, r[1][0].base_labels, r[1][0].n_base, r[1][0].first_word, r[1][0].score) == ("bsd,mpl,spdx", "", 0, None, 1.0)
    assert [(x.labels, x.score) for x in r[2] + r[3]] == [("", 0.0)] * 3


def test_quality(make, corpus):
    rows = [*corpus, (300, "a b c d e f g h\n" * 6), (301, "### $$$ " * 30), (302, "x " * 500)]
    got = sorted((tuple(r) for r in quality.rate(make(rows)).collect()), key=repr)
    assert got == oracle(quality.SQL, rows)
    for r in quality.rate(make(rows)).collect():
        w = spaced(dict(rows)[r.doc_id])
        seen = defaultdict(list)
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].append(k)
        covered = {j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))


@pytest.mark.parametrize("items", [[], [(1, None), (2, "")], [(1, " ".join(f"t{k}" for k in range(25))), (10, "one two three"), (2, " ".join(f"t{k}" for k in range(5, 18))), (3, "w1")]])
def test_decontaminate(make, spark, corpus, items):
    long = " ".join(f"t{k}" for k in range(25))
    rows = [*corpus, (400, "before " + long + " after"), (401, " ".join(f"t{k}" for k in range(9))), (402, ("T3, " * 3) + " ".join(f"t{k}" for k in range(3, 14)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.decontaminate(make(rows), bench))
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    for i, t in rows:
        w, hit, found = alnum(t), set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= ids
        r = got[i][0]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), digest, bool(hit))


def test_stored_index_answers_other_benchmarks(make, spark):
    rows = [(1, "a b c d e f g h i j k"), (2, "x y z"), (2, "x y z"), (3, None), (4, "A-B c"), (None, "x y z")]
    index = decontaminate.build_index(make(rows).repartition(3))
    assert set(index.columns) == {"shard", "term", "places"}
    for items in ([(1, "x y z"), (None, "a b c")], [(7, "b c d e f g h i j k"), (8, "a b c"), (9, None)], []):
        got = by_id(decontaminate.look_up(index, spark.createDataFrame(items, "item_id long, text string")))
        wanted = {i: [k for k, t in items if k is not None and t and alnum(t) and any(holds_window(alnum(x or ""), alnum(t)) for j, x in rows if j == i)] for i in (1, 2, 3, 4)}
        assert {i: got[i][0].item_ids for i in got} == wanted and len(got[2]) == 2


def holds_window(text, item):
    """Whether a window of the item, of ten words or all, stands in the text."""
    n = min(10, len(item))
    windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
    return any(tuple(text[i : i + n]) in windows for i in range(len(text) - n + 1))


def test_proximity():
    block = decontaminate.TestBlock([1], [b"alpha beta gamma"], 10)
    near = [w.split() for w in (b"gamma x x alpha y beta", b"alpha " + b"z " * 30 + b"beta gamma", b"alpha beta")]
    assert decontaminate.search(near, iter([block]), 20)[2] == [{1}, set(), set()]


def test_proximity_of_altered_passages():
    item = [f"t{k}" for k in range(16)]
    altered = item[:7] + ["odd"] + item[8:]
    rows = [altered, item[:3] + ["u"] * 5 + item[8:], item[::-1], item[:12] + ["pad"] * 24 + item[12:], item[:11], item[:6] + ["pad"] * 25 + item[6:12], ["pad"] * 30 + altered]
    items = [1, 2], [" ".join(item).encode(), b"t0 t1"]
    wanted = [{1, 2}, {2}, {1, 2}, {1, 2}, {2}, {2}, {1, 2}]
    found = lambda texts: decontaminate.search([[w.encode() for w in t] for t in texts], iter([decontaminate.TestBlock(*items, 10)]), 20)[2]
    assert found(rows) == wanted == [found([r])[0] for r in rows]  # whatever other texts the slab has
    # Against brute force: every span of a text.
    items = list(range(30)), [" ".join(words(k, 1 + k, 60)).encode() for k in range(30)]
    rows = [words(900 + k, 20 * k, 90) for k in range(12)] + [words(k, 1 + k, 60)[: k - 2] + words(k, 9, 60) for k in range(3, 30)]
    for got, r in zip(found(rows), rows, strict=True):
        near = set()
        for i, t in zip(*items, strict=True):
            own = t.decode().split()
            span, needed = len(own) + 20, -(-3 * len(set(own)) // 4)
            if any(len(set(own) & set(r[a : a + span])) >= needed for a in range(len(r))):
                near.add(i)
        assert got == near


def test_empty_tables(make, spark):
    none = make([])
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for df in (binary_records.record_digests(none, BYTE), packing.pack(none, WORD), licenses.scan(none), quality.rate(none), decontaminate.decontaminate(none, bench)):
        assert df.count() == 0


def test_word_level_ascii():
    # Printable ASCII is lower-cased without the file's normalizer; all else still goes through it.
    import public_tokenizers

    from tessitura.llm.tokens import PieceEncoder

    own = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))

    class Counted:
        calls = 0

        def normalize_str(self, x, normalize=own.tokenizer.normalizer.normalize_str):
            Counted.calls += 1
            return normalize(x)

    plain = own.tokenizer
    own.tokenizer = type("T", (), {"normalizer": Counted(), "encode": staticmethod(plain.encode)})()
    for text, calls in (("It's WE'LL-known, 'S 42nd <b>|~", 0), ("Straße İs K one\x1ctwo", None), ("a <|endoftext|>b", None)):
        ids = b"".join(i.to_bytes(own.width, "little") for i in plain.encode(text, add_special_tokens=False).ids)
        assert own.encode(text) == ids
        assert calls is None or Counted.calls == calls
    assert Counted.calls


def test_byte_pieces_of_ascii(monkeypatch):
    # ASCII needs no pattern with Unicode classes; ids stay the tokenizer's.
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessitura.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    ids = lambda text: plain.encode(text, add_special_tokens=False).ids
    got = lambda text: np.frombuffer(own.encode(text), f"<u{own.width}").tolist()
    for text in ("été <|endoftext|> x", "naïve l'été\nx y", "a  b", " a\tb ", "x\x1cy z", "a\nb c\n\nd e ", "don't. 5a6 ,, ß x<|endoftext|> ª² b"):
        assert got(text) == ids(text)
    monkeypatch.setattr(tokens, "BYTE_LEVEL", None)
    for text in ("Plain words, don't they'll 'sx x's: 12ab3 %%% a-b... I'm", "The so-called end!  No", "a 's 'sa '' '5 5' it's'll"):
        assert got(text) == ids(text)
