"""Operators across documents, against brute force."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tessitura.llm import line_dedup, ngram_join, substring_dedup
from tessitura.llm.common import components, without

from .conftest import words
from .test_scans import ascii_lower, by_id, oracle, spaced


def groups(rows):
    sets = {}
    for i, t in rows:
        w = spaced(ascii_lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(make, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(make([*corpus, (None, "no id")])).collect()}
    assert got == groups(corpus)


def test_ngram_join_of_a_large_group(make, monkeypatch):
    """Copies that link through their original alone, in buckets of several blocks."""
    monkeypatch.setattr(ngram_join, "MEMBERS", 7)
    r = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    rows = [(500, " ".join(base))]
    for k in range(40):
        copy = list(base)
        for j in r.sample(range(0, 120, 6), 2):
            copy[j] = f"e{k}.{j}"
        rows.append((k, " ".join(copy)))
    rows += [(600 + k, " ".join([f"u{k}.{j}" for j in range(40)] + base[:60])) for k in range(20)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(make(rows)).collect()}
    assert got == groups(rows)


@pytest.mark.parametrize("members", [9, 8192])
def test_ngram_join_of_copies_that_are_mostly_not_linked(spark, make, monkeypatch, members):
    """Copies altered by ever more words: a few chains of links, many without; frequent and very frequent tokens."""
    from tessitura.llm import common

    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    r = random.Random(8)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for k in range(150):
        copy = list(base)
        for j in r.sample(range(90), k % 14):
            copy[j] = f"e{k}.{j}"
        rows.append((k, " ".join(copy)))
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = ngram_join.near_duplicates(make(rows))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in found.collect()}
    assert got == groups(rows)
    left = sorted(x.split("-")[1] for x in set(os.listdir(folder)) - before if x.startswith("tessitura-"))
    assert left == ["components", "repeated", "sets", "texts"]


def test_ngram_join_of_long_texts(make):
    """Bitmaps of different sizes."""
    base = words(4, 3000, 100_000)
    rows = [(1, " ".join(base)), (2, " ".join(base[:1500])), (3, " ".join(base[:520])), (4, " ".join(base[:515])), (5, " ".join(base[:2700])), (6, " ".join(base[:2450])), (7, " ".join(base[:450]))]
    rows += [(10 + k, " ".join([*base[: 1040 - 30 * k], f"x{k}"])) for k in range(5)]
    assert len({len(ngram_join.parities(s)) for s in ngram_join.shingle_sets([t.encode() for _, t in rows])}) > 2
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(make(rows)).collect()}
    assert got == groups(rows)


def test_signatures_meet():
    """Any two sets that reach the threshold share a signature, whatever the classes."""
    r = np.random.default_rng(1)
    for trial in range(300):
        n = int(r.integers(1, 120))
        x = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        drop, add = int(r.integers(0, n // 6 + 1)), int(r.integers(0, n // 8 + 1))
        y = np.unique(np.concatenate([np.delete(x, r.choice(len(x), min(drop, len(x) - 1), replace=False)), r.integers(0, 1 << 62, add).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common < 80 * (len(x) + len(y) - common):
            continue
        share = r.random()
        kinds = lambda s: 1 + ((s % np.uint64(1000)).astype(int) < 1000 * share) + ((s % np.uint64(999)).astype(int) < 500 * share) * ((s % np.uint64(1000)).astype(int) < 1000 * share)
        a, b = (ngram_join.signatures(s, kinds(s)) for s in (x, y))
        bits = ngram_join._least_bitmaps(pa.array([ngram_join.parities(x), ngram_join.parities(y)], pa.list_(pa.int64())))
        apart = int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum())
        assert apart <= len(x) + len(y) - 2 * common and 180 * apart <= 20 * (len(x) + len(y))
        assert len(np.intersect1d(a[0], b[0])) + len(np.intersect1d(a[1], b[1])), (trial, len(x), len(y), common)


def test_substring_dedup(make, corpus):
    got = by_id(substring_dedup.substring_digests(make([*corpus, (None, "no id")])))
    real = by_id(substring_dedup.dedup_substrings(make(corpus)))
    seen: set = set()
    for i, t in sorted(corpus, key=lambda x: x[0]):
        w = [x.encode() for x in spaced(t)]
        windows = [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
        gone = {j for k, q in enumerate(windows) if q in seen for j in range(k, k + 13)}
        seen |= set(windows)
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i][0].n_words, got[i][0].n_removed, got[i][0].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest()), i
        assert real[i][0].kept == kept.decode()


@pytest.mark.parametrize("limits", [{"HOT": 3}, {"MOST_BITS": 0}, {"HOT": 3, "MOST_BITS": 0}])
def test_substring_dedup_by_windows_and_by_joins(make, corpus, monkeypatch, limits):
    expected = sorted(map(tuple, substring_dedup.substring_digests(make(corpus)).collect()))
    for k, v in limits.items():
        monkeypatch.setattr(substring_dedup, k, v)
    assert sorted(map(tuple, substring_dedup.substring_digests(make(corpus)).collect())) == expected


def test_one_anchor_in_thousands_of_contexts(make, monkeypatch):
    """A run of nine words between different neighbours: its anchor is hot, its windows are dealt out one by one."""
    common = " ".join(words(5, 9))
    monkeypatch.setattr(substring_dedup, "HOT", 100)
    rows = [(i, " ".join(words(1000 + i, 12)) + " " + common + " " + " ".join(words(90_000 + i % 700, 12))) for i in range(2500)]
    known = {r.anchor: r.hot for r in substring_dedup._shared_anchors(make(rows)).collect()}
    assert any(known.values())
    got = by_id(substring_dedup.substring_digests(make(rows)))
    seen: set = set()
    for i, t in rows:
        w = t.split()
        windows = [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
        gone = {j for k, q in enumerate(windows) if q in seen for j in range(k, k + 13)}
        seen |= set(windows)
        assert got[i][0].n_removed == len(gone), i


def test_fm_index():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 6, int(n)).astype(np.uint64) for n in r.integers(1, 40, 12)]
    index = substring_dedup.FmIndex(texts)
    ends = np.concatenate([s + np.arange(1, len(t) + 1) for s, t in zip(index.starts, texts, strict=True)])
    length, lo, hi = substring_dedup.matching_statistics(index, ends)
    flat = [tuple(t.tolist()) for t in texts]
    k = 0
    for t in flat:
        for e in range(1, len(t) + 1):
            count = lambda p: sum(q[i : i + len(p)] == p for q in flat for i in range(len(q) - len(p) + 1))
            best = max((n for n in range(1, min(e, 13) + 1) if count(t[e - n : e]) >= 2), default=0)
            assert length[k] == best
            if best:
                assert hi[k] - lo[k] == count(t[e - best : e])
            k += 1


def test_line_dedup(make):
    a = "the quick brown fox jumps over the lazy dog today"
    rows = [
        (3, f"{a}\nanother line\nonly two"),
        (1, f"A first text with some words of its own\n{a.upper()}\nfoo"),
        (2, f"{a.replace('fox', 'cat')}\n{a} again\nnew words stand in this line of ten words here"),
        (4, a.replace("quick ", "") + "\n" + a.replace("quick", "slow").replace("dog", "cow")),
        (5, "short one here\nshort one here\nx y\nx y"), (6, None), (7, ""), (8, "\n\n"), (5, "short one here\nanother"), (9, "a b c d e f g h\na b c d e f g i"), (9, "a b c d e f g h\na b c d e f g i"),
    ]
    got = sorted((tuple(r) for r in line_dedup.line_digests(make([*rows, (None, a)])).collect()), key=repr)
    assert got == oracle(line_dedup.SQL, rows)
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(rows[:4])).collect()}
    assert texts == {1: rows[1][1], 2: "new words stand in this line of ten words here", 3: "another line\nonly two", 4: a.replace("quick", "slow").replace("dog", "cow")}
    assert set(line_dedup.dedup_lines(make(rows)).columns) >= set(make([]).columns)


def test_line_dedup_at_random(make):
    r = random.Random(5)
    pool = [" ".join(f"v{r.randrange(4)}" for _ in range(r.choice((8, 9, 10)))) for _ in range(60)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(6))) for i in range(25)]
    assert sorted((tuple(x) for x in line_dedup.line_digests(make(rows)).collect()), key=repr) == oracle(line_dedup.SQL, rows)


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    wanted = {i: find(i) for e in edges if e[0] != e[1] for i in e}
    assert {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()} == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without(make, spark):
    got = without(make([(1, "a"), (2, "b"), (2, "c"), (None, "d")]), spark.createDataFrame([(2,)], "doc_id long"))
    assert [r.doc_id for r in got.collect()] == [1] and got.columns == make([]).columns


@pytest.mark.parametrize("run", [ngram_join.near_duplicates, substring_dedup.substring_digests, line_dedup.line_digests])
def test_empty_tables(make, run):
    assert run(make([])).count() == 0
    assert run(make([(1, None), (2, ""), (3, None)])).count() == 3
