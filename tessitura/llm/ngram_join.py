"""N-gram Jaccard join with token-combination prefixes: near-duplicate groups of documents.

A document's set: its distinct runs of SHINGLE words; two documents link when their sets' Jaccard similarity reaches the
threshold. Sets are 64-bit hashes in one global order: rare tokens first, frequent ones last, each class by hash value.
Frequent are tokens whose cell, in a count of all documents' prefixes over CELLS cells, stands out from the mean; the
table has a fixed size, and any assignment of classes gives right results.

1. Equal texts are one representative, the smallest doc_id.
2. Signatures. Tokens are rare, frequent or very frequent; these classes are indexed as single tokens, pairs and triples.
   A prefix is long enough that whatever two linked sets may differ in, both prefixes hold a rare token, or as many
   tokens of one sub-class of a frequent class as its combinations have. Sub-classes keep the number of combinations in
   proportion to the prefix. They depend on the set's size class, so a set emits combinations for its own class and the
   one below, one of which any partner shares.
3. Candidates. First, members of a signature's bucket are paired with the bucket's centre (most frequent tokens, as an
   original among its altered copies has) and single tokens' also with their nearest three. A set has a bitmap of the
   parities of its tokens, larger for a larger set; two are compared in the smaller one's size, to which the larger one
   folds. Differing bits are no more than differing tokens, so a pair whose bitmaps differ too much is no link and goes
   before any text is looked at. The others are verified on the hashes of all their shingles.
4. Components of the verified links. A bucket whose members are in one component needs no more. The others' bitmaps are
   compared with one another, block by block in the task that streams the bucket, and only pairs of different components
   that may link become rows: at first each member's nearest one, then, after these are verified and joined, all.

Defined results: a text without words (null too) has no shingle and stays alone; fewer words than a shingle: the whole
sequence is the one element; rows with a null doc_id are left out; repeated rows each give a row, equal doc_ids with
different texts are one node of the graph; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, components, documents, drop, gram_hashes, marked_in, mixed, representatives, rows, stored, word_hashes

SHINGLE, PERCENT = 5, 80
CELLS, BLOCK = 1 << 22, 1 << 16
#: A cell is very frequent when its count is so many times the bound for a frequent one.
VERY = 8
NEAREST, SALTS = 3, 16
#: Bits of a set's bitmap: the power of two from 2n on, within these. A linked pair's sizes are one step apart at most.
BITMAP, LARGEST_BITMAP = 1024, 16384
#: Members of a bucket that are compared in one place; a larger bucket is cut into so large blocks, each pair of which meets once.
MEMBERS = 8192

_BOUNDS = [1]
while _BOUNDS[-1] < 1 << 40:
    _BOUNDS.append(-(-_BOUNDS[-1] * 5 // 4))
_BOUNDS_ARRAY = np.array(_BOUNDS)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's different shingles."""
    return [np.unique(gram_hashes(h, min(k, len(h)))) if len(h) else h for h in word_hashes(texts, lower=True)]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """The least number of tokens of a set of n of which one must be in any linked set."""
    return n + percent * n // -100 + 1


def cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def _combinations(tokens: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k tokens of one group; groups lie together."""
    last, found = np.arange(len(tokens)), tokens
    for _ in range(k - 1):
        ends, hashes = [], []
        for apart in range(1, len(tokens)):
            more = last + apart
            at = np.flatnonzero(more < len(tokens))
            at = at[group[more[at]] == group[last[at]]]
            if not len(at):
                break
            ends.append(more[at])
            hashes.append(mixed(found[at] * np.uint64(0x9E3779B97F4A7C15) + tokens[more[at]]))
        if not ends:
            return np.empty(0, np.uint64)
        last, found = np.concatenate(ends), np.concatenate(hashes)
    return found


def signatures(tokens: np.ndarray, kinds: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted set: single rare tokens (kind 1), and combinations of kind 2's pairs and kind 3's triples.

    In a sub-class of which k tokens are combined, k - 1 tokens don't count towards the prefix. Linked sets differ in less
    than the prefix counts, so one sub-class has k tokens that both prefixes hold. A size class whose sets are too small
    for that combines less.
    """
    n, need = len(tokens), prefix_length(len(tokens), percent)
    rare = tokens[kinds == 1]
    if len(rare) >= need or len(rare) == n:
        return rare[:need], np.empty(0, np.uint64)
    if n == 1:  # only an equal set links with it, and that is one token too
        return tokens, np.empty(0, np.uint64)
    often = np.concatenate([tokens[kinds == k] for k in (2, 3)])
    very = np.arange(len(often)) >= int((kinds == 2).sum())
    level = int(np.searchsorted(_BOUNDS_ARRAY, n, "right")) - 1
    need -= len(rare)
    made = []
    for at in {level, max(0, level - 1)}:
        spare = _BOUNDS[at] - prefix_length(_BOUNDS[at], percent)
        parts = max(1, min(_BOUNDS[at] // 10, spare // 3))
        k = np.where(very, 3, 2) if spare >= 3 * parts else np.full(len(often), 2 if spare >= parts else 1)
        group = (mixed(often ^ np.uint64(0x5BD1E995)) % np.uint64(parts)).astype(np.int64) * 4 + k
        order = np.argsort(group, kind="stable")
        begins = np.searchsorted(group[order], group)
        rank = np.empty(len(often), np.int64)
        rank[order] = np.arange(len(often))
        stop = int(np.searchsorted(np.cumsum(rank - begins >= k - 1), need)) + 1
        for size in np.unique(k[:stop]).tolist():
            own = order[(order < stop) & (k[order] == size)]
            made.append(mixed(_combinations(often[own], group[own], size) + mixed(np.array([at], np.uint64))))
    return rare, np.unique(np.concatenate(made))


def parities(tokens: np.ndarray) -> np.ndarray:
    """Bits as longs: bit i tells whether the set has an odd number of tokens that are i mod the number of bits."""
    size = min(max(BITMAP, 1 << (2 * len(tokens)).bit_length()), LARGEST_BITMAP)
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _frequent_cells(docs: DataFrame, shingle: int, percent: int) -> np.ndarray:
    """Two rows with a bit for each cell: whether the count of prefix tokens in it stands out, and by far."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CELLS, np.int32)
        for _, texts in rows(batches):
            found = shingle_sets(texts, shingle)
            taken = [cells(s[: prefix_length(len(s), percent)]) for s in found if len(s)]
            if taken:
                held += np.bincount(np.concatenate(taken), minlength=CELLS).astype(np.int32)
        packer = zstandard.ZstdCompressor(1)
        for b in range(CELLS // BLOCK):
            part = held[b * BLOCK : (b + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "counts": pa.array([packer.compress(part.tobytes())], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(b, np.zeros(BLOCK, np.int64))
                sums[b] += np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.int32)
        for b, total in sums.items():
            mean = total.mean()
            bound = mean + 4 * np.sqrt(mean) + 2
            flags = np.stack([total > bound, total > VERY * bound])
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "flags": pa.array([np.packbits(flags, axis=1).tobytes()], pa.binary())})

    summed = docs.mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, flags binary")
    bits = np.zeros((2, CELLS // 8), np.uint8)
    for row in summed.collect():  # CELLS / BLOCK rows at most, CELLS / 4 bytes in all
        bits[:, row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = np.frombuffer(row["flags"], np.uint8).reshape(2, -1)
    return bits


def _signed(docs: DataFrame, bits, shingle: int, percent: int) -> DataFrame:
    """m (md5 of the text), doc, n, w (how many of its tokens are frequent), singles, combined, parity of every document."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = bits.value
        for keys, texts in rows(batches):
            sizes, shares, singles, combined, parity = [], [], [], [], []
            for tokens in shingle_sets(texts, shingle):
                at = cells(tokens)
                kinds = 1 + ((flags[:, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).sum(axis=0)
                one, more = signatures(tokens, kinds, percent) if len(tokens) else (tokens, tokens)
                singles.append(one.view(np.int64))
                combined.append(more.view(np.int64))
                parity.append(parities(tokens))
                sizes.append(len(tokens))
                shares.append(int((kinds > 1).sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.md5(t).hexdigest() for t in texts]), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(shares, pa.int32()), *(_lists(x, kind) for x in (singles, combined, parity))],
                ["m", "doc", "n", "w", "singles", "combined", "parity"],
            )

    return docs.mapInArrow(run, "m string, doc long, n int, w int, singles array<bigint>, combined array<bigint>, parity array<bigint>")


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], pa.int64()), type=kind)


def _possible(n, m, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _possible_by_frequent(w, v, n, m, percent: int):
    """For documents that meet in a combination. One that has such signatures has all its rare tokens as single ones,
    so if two share a rare token they meet there too; else they share frequent tokens alone, and need enough of them."""
    return (100 + percent) * F.least(w, v) >= percent * (n + m)


def _pairs(found: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of rows with doc and other."""
    return found.where("doc <> other").select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def _first_pairs(signed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of each bucket's members with its centre and nearest; and sig, doc, n, w, paired of buckets that this doesn't cover."""
    singles, combined = (signed.select(F.explode(c).alias("sig"), "doc", "n", "w") for c in ("singles", "combined"))
    within = Window.partitionBy("sig")
    order = within.orderBy(F.desc(F.col("w") / F.col("n")), "doc")
    seen = F.array(F.first(F.struct("doc", "n")).over(order), *(F.lag(F.struct("doc", "n"), i).over(order) for i in range(1, NEAREST + 1)))
    fit = F.filter("seen", lambda p: p.isNotNull() & (p["doc"] != F.col("doc")) & _possible(F.col("n"), p["n"], percent))
    peers = F.array_distinct(F.transform(fit, lambda p: p["doc"]))
    # A rare token stands in few documents: its cell would stand out. A combination may stand in many.
    near = singles.select("sig", "doc", "n", "w", F.count("*").over(within).alias("c"), seen.alias("seen")).where("c > 1")
    near = stored(near.select("sig", "doc", "n", "w", "c", peers.alias("peers")), "singles")
    one = near.select("doc", F.explode("peers").alias("other"))
    top = combined.groupBy("sig").agg(F.count("*").alias("c"), F.max(F.struct((F.col("w") / F.col("n")).alias("share"), (-F.col("doc")).alias("d"), "n", "w")).alias("top")).where("c > 1")
    centred = combined.join(top, "sig")
    two = centred.where(_possible(F.col("n"), F.col("top.n"), percent) & _possible_by_frequent(F.col("w"), F.col("top.w"), F.col("n"), F.col("top.n"), percent))
    two = two.select("doc", (-F.col("top.d")).alias("other"))
    left = near.where(F.col("c") > NEAREST + 1).select("sig", "doc", "n", "w", F.lit(False).alias("paired"))
    left = stored(left.union(centred.where("c > 2").select("sig", "doc", "n", "w", F.lit(True).alias("paired"))), "buckets")
    pairs = stored(_pairs(one.union(two)), "pairs")
    drop(near)
    return pairs, left


def _folded(bits):
    """A bitmap of half the size."""
    half = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _may_link(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps differ in no more bits than linked sets may differ in tokens."""
    facts = facts.select("doc", "n", "parity")
    both = pairs.join(facts.toDF("a", "n", "x"), "a").join(facts.toDF("b", "m", "y"), "b").where(_possible(F.col("n"), F.col("m"), percent))
    x, y = F.col("x"), F.col("y")
    same = F.when(F.size(x) == F.size(y), F.struct(x.alias("x"), y.alias("y")))
    same = same.when(F.size(x) == 2 * F.size(y), F.struct(_folded(x).alias("x"), y.alias("y"))).when(2 * F.size(x) == F.size(y), F.struct(x.alias("x"), _folded(y).alias("y")))
    both = both.select("a", "b", "n", "m", same.alias("s"))  # sizes further apart (a low threshold): no bound
    apart = F.coalesce(F.aggregate(F.zip_with("s.x", "s.y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d), F.lit(0))
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m"))).select("a", "b").distinct()


def _block_pairs(bits: np.ndarray, facts: dict[str, np.ndarray], percent: int, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, k) of members of different components that may link: for each i all such, or the nearest one only.

    Members of the largest component, and of a pair of blocks the second block's, are only partners.
    """
    n, w, component, side, paired = (facts[x] for x in ("n", "w", "component", "side", "paired"))
    names, sizes = np.unique(component, return_counts=True)
    if len(names) < 2:
        return
    two_blocks = side.min() != side.max()
    lead = np.flatnonzero(side == side.min()) if two_blocks else np.flatnonzero(component != names[sizes.argmax()])
    partner = np.flatnonzero(side == side.max()) if two_blocks else np.arange(len(n))
    half = bits.shape[0] // 2
    across = np.ascontiguousarray(bits[:, partner])
    for lo in range(0, len(lead), 64):
        own = lead[lo : lo + 64]
        limit = (100 - percent) * (n[own][:, None] + n[partner][None, :]) // (100 + percent)
        small, large = np.minimum(n[own][:, None], n[partner][None, :]), np.maximum(n[own][:, None], n[partner][None, :])
        fit = (100 * small >= percent * large) & (component[own][:, None] != component[partner][None, :])
        if paired:
            fit &= (100 + percent) * np.minimum(w[own][:, None], w[partner][None, :]) >= percent * (n[own][:, None] + n[partner][None, :])
        apart = np.zeros(fit.shape, np.int16)
        for k in range(half):
            apart += np.bitwise_count(bits[k, own][:, None] ^ across[k][None, :])
        i, j = np.nonzero(fit & (apart <= limit))
        rest = apart[i, j].astype(np.int64)
        for k in range(half, bits.shape[0]):
            rest += np.bitwise_count(bits[k, own[i]] ^ across[k, j])
        near = rest <= limit[i, j]
        i, j, rest = i[near], j[near], rest[near]
        if not every and len(i):
            order = np.lexsort((rest, i))
            order = order[np.unique(i[order], return_index=True)[1]]
            i, j = i[order], j[order]
        yield own[i], partner[j]


def _least_bitmaps(lists: pa.Array) -> np.ndarray:
    """A row of BITMAP bits for each bitmap, folded to that size."""
    ends, flat, least = lists.offsets.to_numpy(), lists.flatten().to_numpy(), BITMAP // 64
    ends = ends - ends[0]
    owner = np.repeat(np.arange(len(lists)), np.diff(ends) // least)
    out = np.zeros((len(lists), least), np.int64)
    np.bitwise_xor.at(out, owner, flat.reshape(-1, least))
    return out


def _bucket_pairs(left: DataFrame, facts: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b) of different components that may link, from left's buckets; left: sig, c, doc, n, w, paired, component."""
    facts = left.join(facts.select("doc", "n", "w", "parity"), ["doc", "n", "w"])
    blocks = F.ceil(F.col("c") / MEMBERS)
    facts = facts.withColumn("side", F.pmod(F.xxhash64("doc"), blocks)).withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    dealt = facts.select("sig", F.least("side", "t").alias("x"), F.greatest("side", "t").alias("y"), "side", "doc", "n", "w", "paired", "component", "parity")
    dealt = dealt.repartition("sig", "x", "y").sortWithinPartitions("sig", "paired", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        held: list[dict[str, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            facts = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            held.clear()
            doc, fresh = facts["doc"], []
            if len(doc) > 1:
                bits = np.ascontiguousarray(facts["parity"].reshape(len(doc), -1).T).view(np.uint64)
                paired = bool(facts["paired"][0])
                for i, k in _block_pairs(bits, facts | {"paired": paired}, percent, every):
                    for pair in zip(np.minimum(doc[i], doc[k]).tolist(), np.maximum(doc[i], doc[k]).tolist(), strict=True):
                        if pair[0] < pair[1] and pair not in told:
                            told.add(pair)
                            fresh.append(pair)
            if len(told) > 500_000:  # only spares repeats; a pair told twice does no harm
                told.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in fresh], pa.int64()), "b": pa.array([p[1] for p in fresh], pa.int64())})

        last = None
        for batch in batches:
            names = [x for x in batch.schema.names if x != "parity"]
            columns = {x: batch.column(batch.schema.names.index(x)).to_numpy(zero_copy_only=False) for x in names}
            columns = {x: c if x in ("sig", "doc", "paired") else c.astype(np.int64) for x, c in columns.items()}
            columns["parity"] = _least_bitmaps(batch.column(batch.schema.names.index("parity")))
            key = np.stack([columns[x].astype(np.int64) for x in ("sig", "paired", "x", "y")])
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1, [batch.num_rows]]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                now = tuple(key[:, a].tolist())
                if held and now != last:
                    yield closed()
                last = now
                held.append({x: c[a:b] for x, c in columns.items()})
        if held:
            yield closed()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def verify(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs that link, by their words. A document that many pairs name is sent once a salt, not once a pair."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    named = docs.where(marked_in(bitmap(ids, F.xxhash64("id")), F.xxhash64("doc_id")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for keys, texts in rows(batches):
            yield pa.RecordBatch.from_pydict({"id": pa.array(keys, pa.int64()), "z": pa.array([packer.compress(t) for t in texts], pa.binary())})

    packed = stored(named.mapInArrow(pack, "id long, z binary"), "packed")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    members = salted.join(packed, F.col("b") == F.col("id")).select("a", "salt", "b", "z")
    heads = salted.select("a", "salt").distinct().join(packed, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sets = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, tokens in _opened(batch, shingle):
                if b is None:
                    sets = [*sets, tokens] if a == head else [tokens]
                    head = a
                    continue
                for own in sets if a == head else []:
                    if 100 * min(len(own), len(tokens)) < percent * max(len(own), len(tokens)):
                        continue
                    common = len(np.intersect1d(own, tokens, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(tokens) - common):
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    # The head's rows come before its members: nulls are first.
    dealt = members.union(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    linked = stored(dealt.mapInArrow(run, "a long, b long"), "links")
    drop(packed)
    return linked


def _opened(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """a, b and the set of each row, some hundred texts at a time."""
    opener = zstandard.ZstdDecompressor()
    a_s, b_s = batch.column(0).to_pylist(), batch.column(2).to_pylist()
    for lo in range(0, batch.num_rows, 256):
        hi = min(lo + 256, batch.num_rows)
        yield from zip(a_s[lo:hi], b_s[lo:hi], shingle_sets([opener.decompress(batch.column(3)[i].as_py()) for i in range(lo, hi)], shingle), strict=True)


def _mixed(left: DataFrame, joined: DataFrame) -> DataFrame:
    """left's buckets with members of several components, with each member's component and the bucket's size c; of
    buckets of the same members one stays."""
    placed = left.select("sig", "doc", "n", "w", "paired").join(joined.withColumnRenamed("id", "doc"), "doc", "left")
    placed = placed.select("sig", "doc", "n", "w", "paired", F.coalesce("component", "doc").alias("component"))
    members = F.sum(F.xxhash64("doc", "n").cast("decimal(20,0)"))
    found = placed.groupBy("sig", "paired").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c"), F.min("doc").alias("first"), F.max("doc").alias("last"), members.alias("members")
    ).where("lo <> hi")
    found = found.dropDuplicates(["paired", "c", "first", "last", "members"]).select("sig", "paired", "c")
    return stored(placed.join(found, ["sig", "paired"]), "buckets")


def links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Of documents with different texts: (id, component) of the linked ones; tables (a, b) of links that hold every
    component together; (m, doc, n) of all."""
    session = docs.sparkSession
    bits = session.sparkContext.broadcast(_frequent_cells(docs, shingle, percent))  # CELLS / 4 bytes, whatever the input
    signed = stored(_signed(docs, bits, shingle, percent), "signatures")
    pairs, left = _first_pairs(signed, percent)
    facts = stored(signed.select("m", "doc", "n", "w", "parity"), "facts")
    drop(signed)
    tested = [stored(_may_link(pairs, facts, percent), "candidates")]
    drop(pairs)
    found = [verify(docs, tested[0], shingle, percent)]
    joined = components(found[0])
    for every in (False, True):
        last, left = left, _mixed(left, joined)
        drop(last)
        more = _bucket_pairs(left, facts, percent, every).join(reduce(DataFrame.union, tested), ["a", "b"], "left_anti")
        fresh = stored(_may_link(more, facts, percent), "candidates")
        tested.append(fresh)
        if not fresh.isEmpty():
            found.append(verify(docs, fresh, shingle, percent))
            last, joined = joined, components(reduce(DataFrame.union, found))
            drop(last)
    known = stored(facts.select("m", "doc", "n"), "sets")
    drop(left, facts, *tested)
    return joined, found, known


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the smallest doc_id that links reach."""
    own = documents(docs)
    alone, _ = representatives(own)
    joined, found, sets = links(alone, shingle, percent)
    drop(*found)
    # Every text has one representative, which stands for its copies.
    known = sets.select("m", F.col("doc").alias("node"), F.col("n").cast("bigint").alias("n_shingles")).dropDuplicates(["m"])
    noded = own.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("m")).join(known, "m")
    noded = noded.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")).alias("id"))
    return noded.join(joined, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
