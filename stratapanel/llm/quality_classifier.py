"""Quality score of whole texts by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by
``OVERLAP`` and together cover all of it.  Learned filters over embedded bytes
are max-pooled inside each chunk; the chunks' maxima are averaged, and maximised,
over the document, and combined into one probability.

The network is trained here, on a sample of labelled rows bounded by parameters:
``TRAIN_ROWS`` rows at most, by the smallest hash of their id, passing over rows
whose text would bring the sample over ``TRAIN_BYTES``.  All chunks of the chosen
texts are used.  Scoring reads every byte and nothing but the text; chunks are
cut and pooled ``POOLED`` at a time, whatever a text's length.

Defined results: null and empty texts are one chunk of padding, and get a score;
null or repeated ids are scored row by row; without labels the score is 0.5;
with labels of one kind, their smoothed share; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapanel.llm.arrow import column, concatenated, slices

CHUNK, OVERLAP = 512, 64
TAPS, STRIDE, WIDTH, FILTERS = 8, 2, 6, 16
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, BATCH, RATE, SEED = 2500, 32 << 20, 12, 64, 0.01, 7
#: Chunks cut and pooled at once.
POOLED = 256
#: Bytes of text scored at once.
SCORED_BYTES = 1 << 18


def chunk_counts(offsets: np.ndarray) -> np.ndarray:
    """Number of overlapping chunks that cover each text; one at least."""
    return np.maximum(1, -(-(np.diff(offsets) - OVERLAP) // (CHUNK - OVERLAP)))


def chunked(raw: np.ndarray, offsets: np.ndarray, counts: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(chunks x CHUNK) bytes, zero beyond a text's end, and each one's document, of the chunks numbered from ``start`` to ``stop``."""
    ends = np.cumsum(counts)
    number = np.arange(start, min(stop, int(ends[-1])))
    doc = np.searchsorted(ends, number, side="right")
    begin = offsets[doc] + (number - (ends - counts)[doc]) * (CHUNK - OVERLAP)
    if not len(raw):
        return np.zeros((len(doc), CHUNK), np.uint8), doc
    at = begin[:, None] + np.arange(CHUNK)
    return np.where(at < offsets[doc + 1][:, None], raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8), doc


class Network:
    def __init__(self, rng: np.random.Generator):
        self.embed = rng.normal(0, 0.5, (256, WIDTH)).astype(np.float32)
        self.filters = rng.normal(0, (TAPS * WIDTH) ** -0.5, (TAPS * WIDTH, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.head = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.head, self.bias]

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """Filter outputs (chunks x positions x filters)."""
        flat = self.embed[chunks].reshape(len(chunks), -1)
        windows = np.lib.stride_tricks.sliding_window_view(flat, TAPS * WIDTH, axis=1)[:, :: STRIDE * WIDTH]
        return windows.reshape(-1, TAPS * WIDTH) @ self.filters

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's maximum of each filter, and where it stands."""
        parts = []
        for k in range(0, len(chunks), POOLED):
            out = self.responses(chunks[k: k + POOLED]).reshape(len(chunks[k: k + POOLED]), -1, FILTERS)
            at = out.argmax(1)
            parts.append((np.take_along_axis(out, at[:, None], 1)[:, 0], at))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def features(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean and maximum over each text's chunks, kept as running sums and maxima."""
        counts = chunk_counts(offsets)
        total, most = np.zeros((len(counts), FILTERS)), np.zeros((len(counts), FILTERS), np.float32)
        for k in range(0, int(counts.sum()), POOLED):
            chunks, doc = chunked(raw, offsets, counts, k, k + POOLED)
            act = np.maximum(self.responses(chunks).reshape(len(chunks), -1, FILTERS).max(1) + self.shift, 0)
            edges = np.flatnonzero(np.diff(doc, prepend=-1))
            total[doc[edges]] += np.add.reduceat(act, edges)
            most[doc[edges]] = np.maximum(most[doc[edges]], np.maximum.reduceat(act, edges))
        return np.hstack([total / counts[:, None], most]).astype(np.float32)

    def combined(self, best: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Features of n documents: mean and maximum over their chunks; every document has a chunk."""
        edges = np.searchsorted(doc, np.arange(n))
        act = np.maximum(best + self.shift, 0)
        mean = np.add.reduceat(act, edges) / np.bincount(doc, minlength=n)[:, None]
        return np.hstack([mean, np.maximum.reduceat(act, edges)]).astype(np.float32)

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.head + self.bias, -30, 30)))


def gradients(net: Network, part: np.ndarray, own: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss over the documents with these chunks, by the network's weights; ``own`` is each chunk's document."""
    best, at = net.pooled(part)
    features = net.combined(best, own, len(label))
    error = ((net.probabilities(features) - label) / len(label)).astype(np.float32)
    back = error[:, None] * net.head
    act = np.maximum(best + net.shift, 0)
    top = act == features[own, FILTERS:]
    top = top / np.add.reduceat(top, np.searchsorted(own, np.arange(len(label))), dtype=np.float32)[own]  # chunks that overlap share a maximum
    grad = (back[own, :FILTERS] / np.bincount(own)[own][:, None] + back[own, FILTERS:] * top) * (act > 0)
    taps = STRIDE * at[..., None] + np.arange(TAPS)  # bytes under each winning window
    seen = part[np.arange(len(part))[:, None, None], taps]
    under = net.embed[seen].reshape(len(part), FILTERS, -1)
    to_filters = np.einsum("nfk,nf->kf", under, grad)
    to_embed = np.zeros_like(net.embed)
    shares = grad[:, :, None, None] * net.filters.T.reshape(FILTERS, TAPS, WIDTH)
    for d in range(WIDTH):
        to_embed[:, d] = np.bincount(seen.ravel(), shares[..., d].ravel(), 256)
    return [to_embed, to_filters, grad.sum(0), features.T @ error, error.sum(keepdims=True)]


def trained(chunks: np.ndarray, doc: np.ndarray, label: np.ndarray) -> Network:
    """Adam on the log loss; ``doc`` is sorted and numbers the rows of ``label``."""
    rng = np.random.default_rng(SEED)
    net = Network(rng)
    edges = np.searchsorted(doc, np.arange(len(label) + 1))
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        for k in range(0, len(order), BATCH):
            rows = order[k: k + BATCH]
            pick = np.concatenate([np.arange(edges[r], edges[r + 1]) for r in rows])
            own = np.repeat(np.arange(len(rows)), edges[rows + 1] - edges[rows])
            step += 1
            for w, g, (m, v) in zip(net.weights(), gradients(net, chunks[pick], own, label[rows]), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (0.5 if epoch >= EPOCHS // 2 else 1) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> list[tuple[int, int, str]]:
    """(doc_id, label, text) of ``rows`` labelled documents with the smallest id hashes, at most ``most`` bytes; equal rows count once."""
    chosen = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)  # ``rows`` small rows
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    joined = joined.withColumn("mark", F.xxhash64("text"))
    keys = ["doc_id", "label", "mark"]
    sizes = joined.select(*keys, F.octet_length("text").alias("size")).distinct().orderBy(F.xxhash64("doc_id"), *keys).limit(rows).collect()
    fit, total = [], 0
    for r in sizes:
        if total + r["size"] <= most:
            total += r["size"]
            fit.append((r["doc_id"], r["label"], r["mark"]))
    wanted = docs.sparkSession.createDataFrame(fit, "doc_id long, label int, mark long")
    found = joined.join(F.broadcast(wanted), keys).dropDuplicates(keys).select(*keys, "text").collect()  # ``most`` bytes
    return [(r["doc_id"], r["label"], r["text"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["label"], r["mark"]))]


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network | float:
    """A network, or the constant score where the labels are of one kind or none."""
    sample = training_rows(docs, labels, rows)
    label = np.array([r[1] for r in sample], np.float32)
    if len(set(label.tolist())) < 2:
        return float((label.sum() + 1) / (len(label) + 2))
    raw, offsets = concatenated(pa.array([r[2] for r in sample], pa.string()))
    counts = chunk_counts(offsets)
    return trained(*chunked(raw, offsets, counts, 0, int(counts.sum())), label)


def scored(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, score of every whole text."""

    def score(part: pa.RecordBatch) -> np.ndarray:
        if isinstance(model, float):
            return np.full(part.num_rows, model)
        raw, offsets = concatenated(column(part, "text"))
        return model.probabilities(model.features(raw, offsets))

    def run(batches):
        for part in slices(batches, "text", SCORED_BYTES):
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(score(part).astype(np.float64), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, score double")
