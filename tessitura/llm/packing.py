"""Lexical retrieval packing: every piece of every document into windows, next to the documents most like it.

Documents are cut into shards of bounded size as a task reads them. A shard has a BM25 inverted index over token ids.
The first unused document is the seed of a window; all its terms are looked up, and the unused neighbours of its shard
with the highest BM25 scores fill the window. The last one taken is cut at the window's edge and its rest is the next seed, so no
window but a task's last has padding; what a shard leaves unfilled goes on as the seed of the next shard. A task's last
tokens are cut into windows whose lengths are powers of two, which need no padding.

No row is moved between tasks: the work is one pass over the input, in memory bounded by a shard.

Defined results: null or empty text: the end id alone; rows with a null doc_id are left out; repeated rows are packed
each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents, rows
from .tokens import encoder

WINDOW = 2048
K1, B = 1.2, 0.75
SHARD_TOKENS, SHARD_DOCS = 1_000_000, 1500
#: Terms that one document in so many holds have their impacts as dense rows: at most 4 * DENSE bytes a posting.
DENSE = 8
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bm25Index:
    """An inverted index of one shard: for each term the documents that hold it, with their BM25 impacts."""

    def __init__(self, docs: list[np.ndarray], vocabulary: int) -> None:
        held = [np.unique(x, return_counts=True) for x in docs]
        self.n = len(docs)
        sizes = np.array([len(t) for t, _ in held], np.int64)
        terms = np.concatenate([t for t, _ in held]) if held else np.empty(0, np.int64)
        tf = np.concatenate([c for _, c in held]).astype(np.float32) if held else np.empty(0, np.float32)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        lengths = np.array([len(x) for x in docs], np.float32)
        df = np.bincount(terms, minlength=vocabulary)
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = K1 * (1 - B + B * lengths / max(1.0, float(lengths.mean()) if self.n else 1.0))
        order = np.argsort(terms, kind="stable")
        self.docs = owner[order]
        self.impact = (self.idf[terms] * tf * (K1 + 1) / (tf + norm[owner]))[order]
        self.ends = np.cumsum(df)
        self.df = df
        self.terms = [t for t, _ in held]
        common = np.flatnonzero(df * DENSE > self.n)
        self.row = np.full(len(df), -1, np.int64)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        for i, t in enumerate(common.tolist()):
            cut = slice(self.ends[t] - df[t], self.ends[t])
            self.dense[i, self.docs[cut]] = self.impact[cut]

    def neighbours(self, terms: np.ndarray, used: np.ndarray, at_most: int) -> np.ndarray:
        """Unused documents by falling BM25 score for all the query's terms that others hold too, ties by place."""
        terms = terms[self.df[terms] > 1]
        if not len(terms):
            return np.empty(0, np.int64)
        rows = self.row[terms]
        scores = self.dense[rows[rows >= 0]].sum(axis=0, dtype=np.float64)
        cuts = [slice(e - n, e) for e, n in zip(self.ends[terms[rows < 0]].tolist(), self.df[terms[rows < 0]].tolist(), strict=True)]
        if cuts:
            scores += np.bincount(np.concatenate([self.docs[c] for c in cuts]), np.concatenate([self.impact[c] for c in cuts]), self.n)
        scores[used] = 0
        found = np.flatnonzero(scores)
        own = scores[found]
        if len(found) > at_most:  # only the best are sorted, with all that tie with the last of them
            best = own >= np.partition(own, len(own) - at_most)[len(own) - at_most]
            found, own = found[best], own[best]
        return found[np.argsort(-own, kind="stable")[:at_most]]


def pack_shard(docs: list[np.ndarray], vocabulary: int, window: int, open_pieces: list[tuple[int, int, int]], emit) -> list[tuple[int, int, int]]:
    """Packs all of docs; open_pieces: (document, start, length) that wait in an unfilled window. Returns those that wait now."""
    index = Bm25Index(docs, vocabulary)
    used = np.zeros(len(docs), bool)
    waiting = list(open_pieces)
    room = window - sum(n for _, _, n in waiting)
    seed = 0

    def place(d: int) -> None:
        nonlocal room, waiting
        used[d] = True
        start, left = 0, len(docs[d])
        while left:
            take = min(left, room)
            waiting.append((d, start, take))
            start, left, room = start + take, left - take, room - take
            if not room:
                emit(waiting)
                waiting, room = [], window

    while True:
        while seed < len(docs) and used[seed]:
            seed += 1
        if seed == len(docs):
            return waiting
        # The window's own first document is the seed: a cut rest, what an earlier shard left, or the next unused one.
        lead = waiting[0][0] if waiting and waiting[0][0] >= 0 else seed
        if not used[lead]:
            place(lead)
            continue
        before = room
        for d in index.neighbours(index.terms[lead], used, 64).tolist():
            place(d)
            if room > before or room == window:  # a window was closed: its rest leads the next
                break
            before = room
        else:
            if not used[seed]:
                place(seed)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        vocabulary = max(own.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        end = end_id.to_bytes(own.width, "little")
        base, made = TaskContext.get().partitionId() << 36, 0
        out: list[tuple[int, int, int, int, int, int, int]] = []
        carried: list[tuple[int, np.ndarray, int, int]] = []  # doc_id, ids, start, length: from earlier shards
        keys: list[int] = []
        held: list[np.ndarray] = []

        def emit(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal made
            offset = 0
            for d, start, n in pieces:
                key, ids = (keys[d], held[d]) if d >= 0 else carried[-d - 1][:2]
                out.append((key, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), base + made, offset))
                offset += n
            made += 1

        def shard() -> None:
            nonlocal carried, keys, held
            waiting = pack_shard(held, vocabulary, window, [(-i - 1, s, n) for i, (_, _, s, n) in enumerate(carried)], emit)
            carried = [((keys[d], held[d]) if d >= 0 else carried[-d - 1][:2]) + (s, n) for d, s, n in waiting]
            keys, held = [], []

        def flush() -> pa.RecordBatch:
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            batch = pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(names)})
            out.clear()
            return batch

        size = 0
        for ks, texts in rows(batches):
            for k, t in zip(ks, texts, strict=True):
                ids = np.frombuffer(own.encode(t.decode()) + end, f"<u{own.width}")
                if held and (size + len(ids) > SHARD_TOKENS or len(held) >= SHARD_DOCS):
                    shard()
                    size = 0
                    yield flush()
                keys.append(k)
                held.append(ids)
                size += len(ids)
        if held:
            shard()
        # The last tokens: windows of the largest powers of two that they fill.
        rest, pieces = sum(n for *_, n in carried), [(-i - 1, s, n) for i, (_, _, s, n) in enumerate(carried)]
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            taken = []
            while room:
                d, s, n = pieces[0]
                take = min(n, room)
                taken.append((d, s, take))
                room -= take
                pieces[0] = (d, s + take, n - take)
                if take == n:
                    pieces.pop(0)
            emit(taken)
        yield flush()

    return documents(docs).mapInArrow(run, _SCHEMA)
