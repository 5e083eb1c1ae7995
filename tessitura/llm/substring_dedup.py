"""Substring dedup: passages of WINDOW words that an earlier document holds, found with FM-indexes.

1. Equal texts are one representative: the smallest doc_id. Any window of another copy is earlier there.
2. Anchors. Each window of 13 words holds nine runs of five words; the one with the least hash is its anchor, wherever
   the window stands. Windows whose anchor no other document has are out. Windows next to one another mostly share their
   anchor; together they are its region, a span of words, and each window lies in one region.
3. Shards. Regions are dealt out by anchor, so a window's occurrences meet; a hot anchor's are dealt out window by
   window. A shard is a compressed FM-index of some anchors' different regions (of regions, not of whole documents): the
   Burrows-Wheeler transform of their words in a wavelet matrix of packed bits with block counts. The shard's own regions
   are then streamed through it by backward search, which gives each position's matching statistic up to the threshold;
   positions that reach it are reported with the least doc_id of their interval.
4. Those reports are joined to each document's regions, and give the spans of words to remove.

Words are compared by 64-bit hashes, thirteen at a time. What is broadcast is bitmaps of bounded size.

Defined results: a null text has no words; fewer words than a window: nothing is removed; windows are judged on the
input; of rows with equal doc_id none is earlier, and what goes from one text goes from the same places of the other; rows with a null doc_id are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, documents, gram_hashes, in_bits, marked_in, packed_bits, representatives, rows, stored, word_hashes

WINDOW, GRAM = 13, 5
SHARD_WORDS = 300_000
#: Anchors in more places than this deal out single windows.
HOT = 4096
#: Shared anchors are sent to the tasks as bitmaps of so many bits (32 MB) at most; beyond that they are joined.
MOST_BITS = 1 << 28


class WaveletMatrix:
    """Rank over a sequence of small integers: a packed bit vector with counts of earlier ones for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        n = len(symbols)
        for shift in range(depth - 1, -1, -1):
            bit = (symbols >> shift) & 1 == 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)
            zeros = n - int(before[-1])
            self.levels.append((words, before, zeros, shift))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def ranks(self, symbols: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each place."""
        at = [np.zeros(len(symbols), np.int64), *places]
        for words, before, zeros, shift in self.levels:
            one = (symbols >> shift) & 1 == 1
            for k, i in enumerate(at):
                block = i >> 6
                ones = before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
                at[k] = np.where(one, zeros + ones, i - ones)
        return [x - at[0] for x in at[1:]]


class FmIndex:
    """An FM-index of several word sequences, ordered by their first `depth` words: it finds patterns of up to so many."""

    def __init__(self, sequences: list[np.ndarray], depth: int = WINDOW) -> None:
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        flat = np.concatenate(sequences)
        self.alphabet, ids = np.unique(flat, return_inverse=True)
        text = np.zeros(int(sizes.sum()) + len(sequences), np.int64)
        held = np.ones(len(text), bool)
        held[self.starts + sizes] = False  # a 0 ends each sequence
        text[held] = ids + 1
        self.text, n = text, len(text)
        rank, span = text.copy(), 1
        while True:
            ahead = np.zeros(n, np.int64)
            if span < n:
                ahead[: n - span] = rank[span:] + 1
            key = rank * (n + len(self.alphabet) + 2) + ahead
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = step
            span *= 2
            if span >= depth or step[-1] == n - 1:
                break
        self.suffixes = order
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(len(self.alphabet)).bit_length()))

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more word before them."""
        first, last = self.bwt.ranks(symbols, lo, hi)
        return self.before[symbols] + first, self.before[symbols] + last


def matching_statistics(index: FmIndex, ends: np.ndarray, most: int = WINDOW, least_hits: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each end place (exclusive) in the index's own text: the length up to `most` of the longest run of words that
    ends there and occurs least_hits times in the index, and the interval of that run."""
    n = len(index.text)
    length, lo, hi = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), n, np.int64)
    live = np.arange(len(ends))
    for back in range(1, most + 1):
        live = live[ends[live] >= back]
        symbols = index.text[ends[live] - back]
        live, symbols = live[symbols > 0], symbols[symbols > 0]
        if not len(live):
            break
        a, b = index.extend(symbols, lo[live], hi[live])
        more = b - a >= least_hits
        live = live[more]
        lo[live], hi[live], length[live] = a[more], b[more], back
    return length, lo, hi


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, number of windows) of each anchor of a document's word hashes, in order."""
    grams = gram_hashes(h, GRAM)
    width = WINDOW - GRAM + 1
    if len(grams) < width:
        empty = np.empty(0, np.int64)
        return empty.astype(np.uint64), empty, empty
    least = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
    first = np.flatnonzero(np.concatenate([[True], np.diff(least) != 0]))
    return grams[least[first]], first, np.diff(np.append(first, len(least)))


def _shared_anchors(docs: DataFrame) -> DataFrame:
    """anchor, hot of those that two documents hold or more; hot: in more than HOT places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in rows(batches):
            found = [np.unique(anchors(h)[0], return_counts=True) for h in word_hashes(texts)]
            yield pa.RecordBatch.from_pydict({"anchor": np.concatenate([a for a, _ in found]).view(np.int64), "n": np.concatenate([n for _, n in found]).astype(np.int32)})

    counted = docs.mapInArrow(run, "anchor long, n int").groupBy("anchor").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    return counted.where("c > 1").select("anchor", (F.col("n") > HOT).alias("hot"))


def _regions(h: np.ndarray, shared, hot) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key, first window, words) of the regions of a text's word hashes whose anchor may be shared.

    shared and hot tell of an array of anchors which are. A hot anchor's region is cut into its windows, each with a key
    of its own: so what meets in one place is at most one window's occurrences, however many contexts the anchor has.
    """
    found, first, count = anchors(h)
    kept = np.flatnonzero(shared(found))
    found, first, count = found[kept], first[kept], count[kept]
    for anchor, at, n, is_hot in zip(found.view(np.int64).tolist(), first.tolist(), count.tolist(), hot(found).tolist(), strict=True):
        if not is_hot:
            yield anchor, at, h[at : at + n + WINDOW - 1]
            continue
        for i in range(at, at + n):
            words = h[i : i + WINDOW]
            yield region_id(words), i, words


def _documents_regions(docs: DataFrame, known: DataFrame, make, schema: str) -> DataFrame:
    """make(list of (doc_id, regions)) as a batch, over all documents in slabs.

    The shared anchors are sent out as two bitmaps while these are small: 32 bits an anchor, MOST_BITS at most. A larger
    set of anchors is joined to the documents that hold them, partition by partition.
    """
    count, n_hot = known.agg(F.count("*"), F.count_if("hot")).first()
    small = 32 * count <= MOST_BITS
    if small:
        size = 1 << max(20, (32 * count).bit_length())
        sent = docs.sparkSession.sparkContext.broadcast((packed_bits(known, "anchor", size), packed_bits(known.where("hot"), "anchor", size if n_hot else 1 << 20)))
    else:

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, texts in rows(batches):
                found = [np.unique(anchors(h)[0]) for h in word_hashes(texts)]
                ids = np.repeat(np.array(keys, np.int64), [len(f) for f in found])
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "anchor": np.concatenate(found).view(np.int64)})

        held = docs.select("doc_id", "text").mapInArrow(own, "doc_id long, anchor long").join(known, "anchor")
        lists = held.groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
        docs = docs.select("doc_id", "text").join(lists, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if small:
            shared, hot = (lambda a, b=b: in_bits(b, a) for b in sent.value)
            for keys, texts in rows(batches, slab=2_000_000):
                yield make([(k, _regions(h, shared, hot)) for k, h in zip(keys, word_hashes(texts), strict=True)])
            return
        for batch in batches:
            for i in range(batch.num_rows):
                key, text, *lists = (batch.column(c)[i].as_py() for c in range(4))
                shared, hot = (lambda a, known=np.array(x, np.int64).view(np.uint64): np.isin(a, known) for x in lists)
                yield make([(key, _regions(word_hashes([(text or "").encode()])[0], shared, hot))])

    return docs.mapInArrow(run, schema)


def region_id(words: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes())).view(np.int64))


def shard_reports(regions: list[np.ndarray], docs: list[int]) -> list[np.ndarray | None]:
    """For each region the least document of each of its windows; None where it is the region's own for all."""
    index = FmIndex(regions)
    windows = np.array([len(r) - WINDOW + 1 for r in regions], np.int64)
    owner = np.repeat(np.arange(len(regions)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    ends = index.starts[owner] + nth + WINDOW
    length, lo, hi = matching_statistics(index, ends)
    own = np.array(docs, np.int64)
    best = own[owner].copy()
    hit = np.flatnonzero(length == WINDOW)
    if len(hit):
        place, back = np.unique(lo[hit], return_inverse=True)
        stop = np.zeros(len(place), np.int64)
        stop[back] = hi[hit]
        by_row = np.append(own[np.searchsorted(index.starts, index.suffixes, "right") - 1], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(by_row, np.stack([place, stop], axis=1).ravel())[::2]
        best[hit] = least[back]
    cuts = np.split(best, np.cumsum(windows)[:-1])
    return [b if (b < d).any() else None for b, d in zip(cuts, docs, strict=True)]


def removed_windows(docs: DataFrame) -> DataFrame:
    """doc_id, starts: first words of the windows that a document with a smaller doc_id holds; docs has no equal texts."""
    known = stored(_shared_anchors(docs), "anchors")

    def cut(found: list) -> pa.RecordBatch:
        held: dict[tuple[int, bytes], list[int]] = {}
        for key, regions in found:
            for anchor, _, words in regions:
                got = held.setdefault((anchor, words.tobytes()), [key, key])
                got[0], got[1] = min(got[0], key), max(got[1], key)
        return pa.RecordBatch.from_pydict({
            "anchor": pa.array([a for a, _ in held], pa.int64()), "words": pa.array([w for _, w in held], pa.binary()),
            "least": pa.array([v[0] for v in held.values()], pa.int64()), "most": pa.array([v[1] for v in held.values()], pa.int64()),
        })

    def places(found: list) -> pa.RecordBatch:
        flat = [(anchor, region_id(words), key, first) for key, regions in found for anchor, first, words in regions]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], pa.int64()) for i in range(4)], ["anchor", "region", "doc_id", "first"])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}  # of one anchor
        shard: list[tuple[int, bytes, int, int]] = []
        last, size = None, 0

        def close() -> None:
            if len(held) > 1 or any(a < b for a, b in held.values()):
                shard.extend((last, w, a, b) for w, (a, b) in held.items())
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if not shard:
                return
            regions = [np.frombuffer(w, np.uint64) for _, w, _, _ in shard]
            found = shard_reports(regions, [a for _, _, a, _ in shard])
            # A region that several documents hold is reported for the later ones even if nothing earlier has its windows.
            out = [
                (anchor, region_id(r), (np.full(len(r) - WINDOW + 1, a, np.int64) if f is None else f).tolist())
                for (anchor, _, a, b), r, f in zip(shard, regions, found, strict=True)
                if f is not None or a < b
            ]
            shard.clear()
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["anchor", "region", "least"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for anchor, words, least, most in zip(*columns, strict=True):
                if anchor != last:
                    close()
                    last = anchor
                    if size >= SHARD_WORDS:
                        yield from flush()
                        size = 0
                got = held.get(words)
                if got is None:
                    held[words] = [least, most]
                    size += len(words) // 8
                else:
                    got[0], got[1] = min(got[0], least), max(got[1], most)
        close()
        yield from flush()

    regions = _documents_regions(docs, known, cut, "anchor long, words binary, least long, most long")
    reports = regions.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(report, "anchor long, region long, least array<bigint>")
    found = _documents_regions(docs, known, places, "anchor long, region long, doc_id long, first long").join(stored(reports, "reports"), ["anchor", "region"])
    start = F.filter(F.transform("least", lambda d, i: F.when(d < F.col("doc_id"), F.col("first") + i)), lambda x: x.isNotNull())
    return found.select("doc_id", start.alias("s")).where(F.size("s") > 0).groupBy("doc_id").agg(F.flatten(F.collect_list("s")).alias("starts"))


def kept_words(words: list[bytes], starts: list[int], window: int = WINDOW) -> list[bytes]:
    change = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.array(starts, np.int64))
    at = at[at + window <= len(words)]
    change[at] += 1
    np.add.at(change, at + window, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every document: kept has the words that stay, with one space between them."""
    return _applied(docs, "kept string", lambda kept: pa.array([k.decode() for k in kept], pa.string()))


def substring_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return _applied(docs, "kept_sha256 string", lambda kept: pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))


def _applied(docs: DataFrame, column: str, of) -> DataFrame:
    own = documents(docs)
    alone, several = representatives(own)
    removed = stored(removed_windows(alone), "windows")
    name = column.split()[0]
    hashed = own.withColumn("m", F.md5(F.coalesce("text", F.lit(""))))
    # Whatever is not the first of its text goes as a whole, if it has a window. Its ids are found without the texts.
    maybe = hashed.where(marked_in(bitmap(several, F.xxhash64("m")), F.xxhash64("m"))).select("doc_id", "m")
    copies = stored(maybe.join(several, "m").where("doc_id > node").select("doc_id", "m", F.lit(True).alias("copy")).distinct(), "copies")
    touched = marked_in(bitmap(removed.select("doc_id").union(copies.select("doc_id")), F.xxhash64("doc_id")), F.xxhash64("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            starts, copied = batch.column(2), batch.column(3).to_pylist()
            for i, t in enumerate(batch.column(1).cast(pa.large_binary())):
                words = (t.as_py() or b"").split()
                own_starts = starts[i].as_py() or []
                left = [] if copied[i] and len(words) >= WINDOW else kept_words(words, own_starts) if own_starts else words
                sizes.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), of(kept)], ["doc_id", "n_words", "n_removed", name])

    schema = f"doc_id long, n_words long, n_removed long, {column}"
    none = F.lit(None).cast("array<bigint>").alias("starts")
    plain = hashed.where(~touched).select("doc_id", "text", none, F.lit(False).alias("copy")).mapInArrow(run, schema)
    joined = hashed.where(touched).join(removed, "doc_id", "left").join(copies, ["doc_id", "m"], "left").select("doc_id", "text", "starts", "copy").mapInArrow(run, schema)
    return plain.union(joined)
