"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character 3- to 5-grams (with word edges) and of its whole form; all are hashed
into one table, so an unseen misspelling shares most of its vectors with the word it comes from. A segment is SEGMENT
words in a row, beginning at any word, and the mean of them; a linear softmax over that mean gives the segment's
probability, and a text scores as its highest segment, so an insult in a long text isn't averaged away. Table, softmax and
bias are trained together: first on the whole text's mean, then on each text's highest segment (for clean texts also on
high ones and on some drawn at random).

The training sample is bounded: at most TRAIN_TOXIC and TRAIN_CLEAN labelled texts (see drawn). It is trained on in one
task. Scoring covers every whole text of any length.

Defined results: null or empty text: the score of an empty mean (the bias alone); rows with a null doc_id are left out;
repeated rows each give a row; without labels of both kinds every score is the share of toxic labels, nearly (0 without
any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, _give_back, documents, rows, stored

TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES, TRAIN_TOTAL = 600, 2500, 6_000, 12_000_000
SEGMENT, DIM, BUCKETS, GRAMS = 2, 8, 1 << 18, (3, 4, 5)
WARM, EPOCHS, RATE, FLOOR, TOXIC_SHARE, SEED = 6, 40, 0.1, 0.005, 0.3, 20260928
#: Of a clean text's segments the highest, those whose logit is over HARD, and a share of DRAWN are trained on.
HARD, DRAWN = -1.0, 0.03
THRESHOLD = 0.3
#: Words whose score a worker remembers.
KNOWN_WORDS = 300_000


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' grams in a row, and where each word's begin. Every word has its whole form at least."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(flat))  # bytes up to the word's end
    found, owners = [], []
    power = np.uint64(0x100000001B3)
    h = np.zeros(len(flat), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        h = h[: len(flat) - k + 1] * power + flat[k - 1 :] if k > 1 else flat + np.uint64(1)
        if k in GRAMS:
            at = np.flatnonzero(left[: len(h)] >= k)
            found.append(h[at] + np.uint64(k))
            owners.append(owner[at])
    weights = np.cumprod(np.full(int(sizes.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
    whole = np.add.reduceat(flat * weights[np.arange(len(flat)) - np.repeat(starts, sizes)], starts) if len(words) else np.empty(0, np.uint64)
    found.append(whole)
    owners.append(np.arange(len(words)))
    value, own = np.concatenate(found), np.concatenate(owners)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=len(words))
    return (value[order] >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), np.cumsum(counts) - counts


class Model:
    """The trained table folded to one number a bucket: the softmax of two classes needs their logits' difference alone."""

    def __init__(self, gains: np.ndarray, bias: float) -> None:
        self.gains, self.bias = gains, bias
        self.words: dict[bytes, float] = {}

    def word_gains(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        new = list({w for w in words if w not in known})
        if new:
            buckets, starts = gram_buckets(new)
            sums = np.add.reduceat(self.gains[buckets], starts)
            counts = np.diff(np.append(starts, len(buckets)))
            fresh = dict(zip(new, (sums / counts).tolist(), strict=True))
            if len(known) + len(fresh) > KNOWN_WORDS:
                known.clear()
                fresh |= {w: g for w, g in zip(words, self.word_gains(words).tolist(), strict=True)} if len(new) < len(set(words)) else {}
            known.update(fresh)
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def score(self, words: list[bytes]) -> float:
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        g = self.word_gains(words)
        best = np.lib.stride_tricks.sliding_window_view(g, min(SEGMENT, len(g))).mean(axis=1).max()
        return float(1 / (1 + np.exp(-(best + self.bias))))


def train(texts: list[bytes], labels: list[int]) -> Model:
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), 40.0 if share == 1 else -40.0)
    vocabulary: dict[bytes, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.translate(ALNUM).split()], np.int32) for t in texts]
    buckets, starts = gram_buckets(list(vocabulary))
    counts = np.diff(np.append(starts, len(buckets)))
    lengths = np.array([len(x) for x in ids])
    flat = np.concatenate(ids)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    # A segment begins at every word that has enough words behind it; a shorter text is one segment.
    n_segments = np.where(lengths > 0, np.maximum(1, lengths - SEGMENT + 1), 0)
    first = np.cumsum(n_segments) - n_segments
    segment_doc = np.repeat(np.arange(len(ids), dtype=np.int32), n_segments)
    sizes = np.minimum(SEGMENT, lengths).astype(np.int32)[segment_doc]
    # A segment's place in flat: its own number and the words of earlier texts that begin none.
    segment_start = ((np.cumsum(lengths) - lengths) - first).astype(np.int32)[segment_doc] + np.arange(len(segment_doc), dtype=np.int32)
    filled = np.flatnonzero(n_segments)
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.1, (DIM, BUCKETS)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)
    owner = np.repeat(np.arange(len(vocabulary)), counts)
    square = [np.zeros((DIM, BUCKETS)), np.zeros((DIM, 2)), np.zeros(2)]

    for epoch in range(WARM + EPOCHS):
        vectors = np.stack([np.add.reduceat(t[buckets], starts) / counts for t in table])
        if epoch < WARM:
            group, target, size = doc, y, np.maximum(lengths, 1)
            used = flat
        else:
            gains = (soft[:, 1] - soft[:, 0]) @ vectors
            sums = np.concatenate([[0.0], np.cumsum(gains[flat])])
            means = (sums[segment_start + sizes] - sums[segment_start]) / sizes
            highest = np.full(len(ids), -np.inf)
            highest[filled] = np.maximum.reduceat(means, first[filled])
            clean = y[segment_doc] == 0
            near = means + (bias[1] - bias[0]) > HARD
            chosen = np.flatnonzero((means == highest[segment_doc]) | clean & (near | (rng.random(len(means)) < DRAWN)))
            size, target = sizes[chosen], y[segment_doc[chosen]]
            group = np.repeat(np.arange(len(chosen)), size)
            used = flat[np.repeat(segment_start[chosen], size) + np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)]
        weight = np.where(target == 1, TOXIC_SHARE / max(1, (target == 1).sum()), (1 - TOXIC_SHARE) / max(1, (target == 0).sum()))
        mean = np.stack([np.bincount(group, v[used], len(size)) / size for v in vectors])
        logits = soft.T @ mean + bias[:, None]
        p = np.exp(logits - logits.max(axis=0))
        p /= p.sum(axis=0)
        error = (p - np.stack([1 - target, target])) * weight
        to_mean = soft @ error / size
        to_word = [np.bincount(used, m[group], len(vocabulary)) / counts for m in to_mean]
        to_table = np.stack([np.bincount(buckets, w[owner], BUCKETS) for w in to_word])
        # Steps of about RATE for whatever has much evidence; a gram of little evidence moves little.
        for k, (value, slope) in enumerate(((table, to_table), (soft, mean @ error.T), (bias, error.sum(axis=1)))):
            square[k] = 0.9 * square[k] + 0.1 * slope**2
            size = np.sqrt(square[k])
            value -= (RATE * slope / (size + FLOOR * size.max() + 1e-12)).astype(value.dtype)
    return Model((soft[:, 1] - soft[:, 0]) @ table.astype(np.float64), float(bias[1] - bias[0]))


def held_out(doc_id):
    """Whether a row's label is kept out of the training."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def drawn(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the training sample. Repeated labels of an id: the highest.

    Texts of at most TRAIN_BYTES come first, longer ones only where these are too few; within a kind, texts are taken in
    the order of a hash of doc_id until their lengths reach TRAIN_TOTAL (the first one whatever its length).
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    sizes = documents(docs).select("doc_id", F.octet_length("text").cast("bigint").alias("bytes")).where("bytes > 0").groupBy("doc_id").agg(F.max("bytes").alias("bytes"))
    order = [(F.col("bytes") > TRAIN_BYTES).asc(), F.xxhash64("doc_id").asc(), F.col("doc_id").asc()]
    both = stored(known.join(sizes, "doc_id"), "labelled")
    first = [both.where(F.col("toxic") == kind).orderBy(*order).limit(n) for kind, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    before = F.sum("bytes").over(Window.partitionBy("toxic").orderBy(*order)) - F.col("bytes")
    # At most TRAIN_TOXIC + TRAIN_CLEAN rows from here on.
    return first[0].union(first[1]).withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.col("bytes") <= TRAIN_TOTAL)).select("doc_id", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on the bounded sample of labelled rows that are not held out, in one task; the driver gets the table alone."""
    sample = stored(drawn(docs, labels), "drawn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, kinds = [], []
        for batch in batches:
            texts += [t.encode() for t in batch.column(0).to_pylist()]
            kinds += batch.column(1).to_pylist()
        model = train(texts, kinds)
        del texts, kinds
        _give_back()
        yield pa.RecordBatch.from_pydict({"gains": pa.array([model.gains.astype(np.float32).tobytes()], pa.binary()), "bias": [model.bias]})

    texts = documents(docs).where(F.octet_length("text") > 0).join(F.broadcast(sample), "doc_id")
    # One task, of bounded size: some thousand texts of TRAIN_TOTAL bytes a kind in all (twice where ids repeat).
    own = texts.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).orderBy("doc_id", "text").limit(2 * (TRAIN_TOXIC + TRAIN_CLEAN))
    got = own.select("text", "toxic").coalesce(1).mapInArrow(run, "gains binary, bias double").collect()
    return Model(np.frombuffer(got[0]["gains"], np.float32).astype(np.float64), got[0]["bias"]) if got else train([], [])


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.gains.astype(np.float32), model.bias))  # BUCKETS numbers, whatever the input
    kept: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Model(sent.value[0].astype(np.float64), sent.value[1]))
        for keys, texts in rows(batches):
            found = [kept[0].score(t.translate(ALNUM).split()) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "score": pa.array(found, pa.float64())})

    scored = documents(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
