"""Benchmark decontamination with a positional inverted index of the training texts.

Postings are stored in the shared folder: for every term of a shard of texts the gaps between its positions. A test set
is answered from them alone, texts are not read again: postings of the test set's terms (a semi join) are dealt by shard,
and the task that has a shard finds a test window by starting from its rarest term there and intersecting the lists,
each shifted by the term's place in the window, so common words are touched last and only where the rare ones agree.
Windows with a term that the shard lacks are dropped at once. Proximity: an item is near where three quarters of its
different terms, absent ones being misses, lie within a span of its own length and `slop` words more, in one text.
Every such span holds one of the item's rarest terms (as many as may miss and one more), so only their places are tried;
what is found is the same whatever texts a shard holds.

The test set is stored once in the shared folder too and each task reads it block by block: its size is bounded by no
broadcast.

Defined results: null text: no words and no hit; an item without words has no window; an item of fewer words than a
window is one window by itself; repeated rows each give a row; rows with a null doc_id, items with a null item_id are
left out; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, documents, filesystem, fresh_path, rows, stored

WORDS, SLOP, BLOCK_ITEMS, SHARD_BYTES = 10, 20, 20_000, 8_000_000
_NOWHERE = np.empty(0, np.int64)
#: The share of an item's different terms that a near place has, in quarters.
NEAR_QUARTERS = 3
_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long, item_ids array<long>"


class TestBlock:
    """Some items' windows as rows of term ids, windows that several items share kept once."""

    def __init__(self, ids: list[int], texts: list[bytes], words: int) -> None:
        self.terms: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = defaultdict(set)
        self.items: list[tuple[int, list[int], int]] = []  # item, its different terms, its words
        for item, text in zip(ids, texts, strict=True):
            own = [self.terms.setdefault(w, len(self.terms)) for w in text.translate(ALNUM).split()]
            for i in range(max(1, len(own) - words + 1) if own else 0):
                windows[tuple(own[i : i + words])].add(item)
            self.items.append((item, sorted(set(own)), len(own)))
        self.windows = list(windows.items())
        self.width = max((len(w) for w, _ in self.windows), default=0)
        self.grid = np.full((len(self.windows), max(1, self.width)), -1, np.int64)
        for i, (w, _) in enumerate(self.windows):
            self.grid[i, : len(w)] = w


class PositionalIndex:
    """Positions of each test term in a shard: the texts, of these sizes, lie one behind another with a gap between."""

    def __init__(self, sizes: np.ndarray, held: dict[bytes, np.ndarray], terms: dict[bytes, int]) -> None:
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        lists = [held.get(t, _NOWHERE) for t in terms] or [_NOWHERE]
        self.df = np.array([len(x) for x in lists], np.int64)
        self.ends = np.cumsum(self.df)
        self.positions = np.concatenate(lists)
        self.flat = np.full(int(self.starts[-1]), -1, np.int32)
        self.flat[self.positions] = np.repeat(np.arange(len(lists), dtype=np.int32), self.df)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term] - self.df[term] : self.ends[term]]

    @staticmethod
    def within(wanted: np.ndarray, there: np.ndarray) -> np.ndarray:
        at = np.searchsorted(there, wanted)
        at[at == len(there)] = 0
        return there[at] == wanted

    def phrase(self, window: tuple[int, ...]) -> np.ndarray:
        """Start positions of the window, from its rarest term on."""
        order = sorted(range(len(window)), key=lambda i: self.df[window[i]])
        starts = self.postings(window[order[0]]) - order[0]
        for i in order[1:]:
            if not len(starts):
                break
            starts = starts[self.within(starts + i, self.postings(window[i]))]
        return starts

    def near(self, terms: list[int], span: int) -> np.ndarray:
        """Texts in which NEAR_QUARTERS quarters of the terms, rounded up, lie within so many words in a row."""
        needed = -(-len(terms) * NEAR_QUARTERS // 4)
        spare = len(terms) - needed
        rare = sorted(terms, key=lambda t: self.df[t])
        if not terms or not self.df[rare[spare]]:
            return np.empty(0, np.int64)
        found = np.sort(np.concatenate([self.postings(t) for t in rare[: spare + 1]]))
        doc = self.doc_of(found)
        lo, hi = np.maximum(found - span + 1, self.starts[doc]), np.minimum(found + span - 1, self.starts[doc + 1] - 2)
        missed = np.zeros(len(found), np.int64)
        for t in rare:
            there = self.postings(t)
            missed += np.searchsorted(there, hi, "right") == np.searchsorted(there, lo)
            keep = missed <= spare
            if not keep.all():
                found, doc, lo, hi, missed = found[keep], doc[keep], lo[keep], hi[keep], missed[keep]
            if not len(found):
                break
        wanted, near = set(terms), set()
        for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True):
            if d not in near and self._holds(self.flat[a : b + 1], wanted, needed, span):
                near.add(d)
        return np.array(sorted(near), np.int64)

    @staticmethod
    def _holds(words: np.ndarray, wanted: set[int], needed: int, span: int) -> bool:
        """Whether so many different wanted terms lie within span words in a row."""
        last: dict[int, int] = {}
        for i, t in enumerate(words.tolist()):
            if t in wanted:
                last[t] = i
                if len(last) >= needed and sum(j > i - span for j in last.values()) >= needed:
                    return True
        return False

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def _binaries(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary value of each run of values that ends there."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def postings(texts: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], pa.Array]:
    """The texts' numbers of words, their different terms, and for each the gaps between its positions, the first from 0."""
    terms: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.concatenate([np.fromiter(map(terms.__getitem__, t), np.int32, len(t)) for t in texts])
    order = np.argsort(ids, kind="stable")
    places = (np.arange(len(ids)) + np.repeat(np.arange(len(texts)), sizes))[order]  # a gap behind each text
    ends = np.cumsum(np.bincount(ids, minlength=len(terms)))
    gaps = np.diff(places, prepend=0)
    gaps[ends[:-1]] = places[ends[:-1]]
    return sizes, list(terms), _binaries(ends, gaps.astype(np.int32))


def search(texts: list[list[bytes]], blocks: Iterator[TestBlock], slop: int) -> tuple[np.ndarray, list[set[int]], list[set[int]]]:
    """search_postings in a shard of texts at hand."""
    sizes, terms, places = postings(texts)
    return search_postings(sizes, dict(zip(terms, places.to_pylist(), strict=True)), blocks, slop)


def search_postings(sizes: np.ndarray, places: dict[bytes, bytes], blocks: Iterator[TestBlock], slop: int) -> tuple[np.ndarray, list[set[int]], list[set[int]]]:
    """For each text of a shard: its hit words, items with exact windows, items with proximity matches."""
    held = {t: np.cumsum(np.frombuffer(p, np.int32), dtype=np.int64) for t, p in places.items()}
    exact: list[set[int]] = [set() for _ in sizes]
    near: list[set[int]] = [set() for _ in sizes]
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    change = np.zeros(int(starts[-1]) + 1, np.int64)
    for block in blocks:
        index = PositionalIndex(sizes, held, block.terms)
        df = np.concatenate([index.df, [1]])  # the last for the grid's padding
        for i in np.flatnonzero((df[block.grid] > 0).all(axis=1)).tolist() if block.windows else []:
            window, items = block.windows[i]
            found = index.phrase(window)
            if len(found):
                np.add.at(change, found, 1)
                np.add.at(change, found + len(window), -1)
                for d in np.unique(index.doc_of(found)).tolist():
                    exact[d] |= items
        for item, terms, n_words in block.items:
            for d in index.near(terms, n_words + slop).tolist():
                near[d].add(item)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return covered[starts[1:]] - covered[starts[:-1]], exact, near


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs: shard, term, places (gaps between the term's positions, the first from 0).

    A shard is about SHARD_BYTES of texts that a task reads in a row; a longer text is one by itself. The shard's row
    with an empty term holds its doc_ids and then their numbers of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (keys, texts) in enumerate(rows(batches, slab=SHARD_BYTES)):
            sizes, terms, places = postings([t.translate(ALNUM).split() for t in texts])
            head = np.concatenate([np.array(keys, np.int64), sizes])
            for names, lists in (([b""], _binaries(np.array([len(head)]), head)), (terms, places)):
                shard = pa.array(np.full(len(names), task << 32 | number))
                yield pa.RecordBatch.from_arrays([shard, pa.array(names, pa.binary()), lists], ["shard", "term", "places"])

    return stored(documents(docs).mapInArrow(run, "shard long, term binary, places binary"), "postings")


def _terms(benchmark: DataFrame) -> DataFrame:
    """The test set's different terms, and the empty one of the shards' heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in rows(batches, "item_id"):
            found = {w for t in texts for w in t.translate(ALNUM).split()}
            yield pa.RecordBatch.from_pydict({"term": pa.array(sorted(found), pa.binary())})

    head = benchmark.sparkSession.range(1).select(F.lit(b"").alias("term"))
    return head.union(benchmark.mapInArrow(run, "term binary")).distinct()


def look_up(index: DataFrame, benchmark: DataFrame, words: int = WORDS, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, item_ids of every indexed document."""
    path = fresh_path(index.sparkSession, "benchmark")
    benchmark = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull())
    benchmark.write.parquet(path)
    benchmark = index.sparkSession.read.schema("item_id long, text string").parquet(path)
    kept: list[TestBlock] = []

    def blocks() -> Iterator[TestBlock]:
        if kept:
            yield from kept
            return
        fs, base = filesystem(path)
        made = 0
        for batch in pads.dataset(base, filesystem=fs, format="parquet", schema=pa.schema([("item_id", pa.int64()), ("text", pa.string())])).to_batches(batch_size=BLOCK_ITEMS):
            if batch.num_rows:
                made += 1
                block = TestBlock(batch.column(0).to_pylist(), [(t or "").encode() for t in batch.column(1).to_pylist()], words)
                if made == 1:
                    first = block
                yield block
        if made == 1:  # a small test set is compiled once a worker
            kept.append(first)

    def answer(shard: list[tuple[list[bytes], list[bytes]]]) -> pa.RecordBatch:
        held = {t: p for terms, places in shard for t, p in zip(terms, places, strict=True)}
        keys, sizes = np.frombuffer(held.pop(b""), np.int64).reshape(2, -1)
        hit, exact, near = search_postings(sizes, held, blocks(), slop)
        ordered = [sorted(x) for x in exact]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(keys, pa.int64()),
            "n_words": pa.array(sizes, pa.int64()),
            "n_hit": pa.array(hit, pa.int64()),
            "n_items": pa.array([len(x) for x in ordered], pa.int64()),
            "items_sha256": [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in ordered],
            "contaminated": pa.array(hit > 0),
            "n_near_items": pa.array([len(x) for x in near], pa.int64()),
            "item_ids": pa.array(ordered, pa.list_(pa.int64())),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[list[bytes], list[bytes]]] = []
        last = None
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(names, prepend=names[:1], append=names[-1:])).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if a == b:
                    continue
                if shard and names[a] != last:
                    yield answer(shard)
                    shard = []
                last = names[a]
                shard.append((batch.column(1)[a:b].to_pylist(), batch.column(2)[a:b].to_pylist()))
        if shard:
            yield answer(shard)

    wanted = index.join(_terms(benchmark), "term", "left_semi").select("shard", "term", "places")
    return wanted.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, _SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, slop: int = SLOP) -> DataFrame:
    """look_up in an index of docs that is stored first; keep build_index's table for more than one test set."""
    return look_up(build_index(docs), benchmark, words, slop)
