"""Quality by a byte-level convolutional network in numpy (operator 9).

Bytes are coded by fixed features (classes of characters, and bits that tell bytes apart). ``FILTERS`` learned filters
of three groups of four bytes move by four bytes over the whole document. Their rectified outputs are max-pooled over
chunks of 512 bytes that overlap by half; mean, maximum and minimum over the chunks go through one logistic unit.
Training takes at most ``SAMPLE`` labelled documents (documented bound), whole, in one task, by Adam with gradients through the
pooled places; scoring runs over all documents in blocks of bounded memory.

Training is bounded by rows and by bytes (``labels.py``); a step takes at most ``BATCH`` texts of together about ``BATCH_BYTES``.

Null and empty texts are one chunk of padding and get the score that the network gives to it. Without
labels the network is untrained and every score is about one half. Rows with equal ids are scored each for itself; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import text_blocks
from tenure.llm.labels import held_out, in_bound, training_sample

SAMPLE, EPOCHS, BATCH, RATE = 1500, 8, 50, 0.01
GROUP, SPAN, FILTERS, HOP = 4, 3, 32, 256
BLOCK, BATCH_BYTES = 1 << 20, 1 << 20


def _codes() -> np.ndarray:
    code = np.zeros((256, 12), np.float32)
    classes = [range(65, 91), range(97, 123), range(48, 58), (9, 10, 13, 32), b".,;:'\"-()?", b"#*$%&|<>!~^@=_+/\\", range(128, 256)]
    for k, members in enumerate(classes):
        code[list(members), k] = 1
    bits = (np.arange(256)[:, None] >> np.arange(5)) & 1
    code[:, 7:] = bits - 0.5
    code[0] = 0  # padding
    return code


CODES = _codes()
WIDTH = GROUP * CODES.shape[1]


def start(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return {"w": rng.normal(0, 0.25, (SPAN * WIDTH, FILTERS)).astype(np.float32), "b": np.zeros(FILTERS, np.float32), "u": np.zeros(3 * FILTERS, np.float32), "c": np.zeros(1, np.float32)}


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with zeros behind each, up to whole hops (a filter's width at least), and the hops of each row."""
    size = np.diff(offsets)
    hops = -(-(size + GROUP * SPAN) // HOP)
    out = np.zeros(int(hops.sum()) * HOP, np.uint8)
    at = (np.cumsum(hops) - hops) * HOP
    out[np.arange(len(data)) + np.repeat(at - offsets[:-1], size)] = data
    return out, hops


def convolve(net: dict[str, np.ndarray], coded: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Filter outputs at each group of bytes, over it and the groups before it."""
    g = coded.reshape(-1, WIDTH)
    lead = np.zeros((SPAN - 1, WIDTH), np.float32) if before is None else before
    g = np.concatenate([lead, g])
    n = len(g) - SPAN + 1
    z = g[SPAN - 1 :] @ net["w"][(SPAN - 1) * WIDTH :]
    for k in range(SPAN - 1):
        z += g[k : k + n] @ net["w"][k * WIDTH : (k + 1) * WIDTH]
    return z


def hop_maxima(net: dict[str, np.ndarray], text: np.ndarray) -> np.ndarray:
    """Maximum of each filter in each hop; in blocks, so memory doesn't grow with the text."""
    out, lead = [], None
    for a in range(0, len(text), BLOCK):
        coded = CODES[text[a : a + BLOCK]]
        z = convolve(net, coded, lead)
        lead = coded.reshape(-1, WIDTH)[-(SPAN - 1) :]
        out.append(z.reshape(-1, HOP // GROUP, FILTERS).max(axis=1))
    return np.maximum(np.concatenate(out) + net["b"], 0)


def chunks(hop: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of the chunks: two hops each, one chunk at least per row; and the first chunk of each row."""
    first = np.cumsum(hops) - hops
    last = first + hops - 1
    pair = np.maximum(hop, np.append(hop[1:], hop[-1:], axis=0))
    pair[last] = hop[last]  # a row's last chunk is its last hop
    return pair, first


def pooled(chunk: np.ndarray, first: np.ndarray, hops: np.ndarray) -> np.ndarray:
    mean = np.add.reduceat(chunk, first, axis=0) / hops[:, None]
    return np.concatenate([mean, np.maximum.reduceat(chunk, first, axis=0), np.minimum.reduceat(chunk, first, axis=0)], axis=1)


def predict(net: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    text, hops = padded(data, offsets)
    z = pooled(*chunks(hop_maxima(net, text), hops), hops) @ net["u"] + net["c"]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def loss(net: dict[str, np.ndarray], text: np.ndarray, hops: np.ndarray, label: np.ndarray) -> float:
    """Mean negative log likelihood of the labels."""
    z = pooled(*chunks(hop_maxima(net, text), hops), hops).astype(np.float64) @ net["u"] + net["c"]
    return float((np.logaddexp(0, z) - label * z).mean())


def gradient(net: dict[str, np.ndarray], text: np.ndarray, hops: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of ``loss``; a maximum passes its gradient to the place that it comes from."""
    coded = CODES[text]
    z = convolve(net, coded).reshape(-1, HOP // GROUP, FILTERS)
    place = z.argmax(axis=1)
    raw = np.take_along_axis(z, place[:, None], axis=1)[:, 0] + net["b"]
    hop = np.maximum(raw, 0)
    chunk, first = chunks(hop, hops)
    x = pooled(chunk, first, hops)
    p = 1 / (1 + np.exp(-np.clip(x @ net["u"] + net["c"], -30, 30)))
    e = ((p - label) / len(label)).astype(np.float32)
    row = np.repeat(np.arange(len(hops)), hops)
    dx = e[:, None] * net["u"]
    dchunk = dx[row, :FILTERS] / hops[row][:, None]
    for k, best in ((1, x[:, FILTERS : 2 * FILTERS]), (2, x[:, 2 * FILTERS :])):
        hit = chunk == best[row]
        share = hit / np.maximum(np.add.reduceat(hit, first, axis=0, dtype=np.float32), 1)[row]
        dchunk += share * dx[row, k * FILTERS : (k + 1) * FILTERS]
    after = np.append(hop[1:], hop[-1:], axis=0)
    after[first + hops - 1] = -1
    own = hop >= after
    dhop = dchunk * own
    dhop[1:] += (dchunk * ~own)[:-1]
    dhop *= raw > 0
    g = np.concatenate([np.zeros((SPAN - 1, WIDTH), np.float32), coded.reshape(-1, WIDTH)])
    dw = np.zeros_like(net["w"])
    at = np.arange(len(place))[:, None] * (HOP // GROUP) + place
    for f in range(FILTERS):
        used = np.flatnonzero(dhop[:, f])
        for k in range(SPAN):
            dw[k * WIDTH : (k + 1) * WIDTH, f] = dhop[used, f] @ g[at[used, f] + k]
    return {"w": dw, "b": dhop.sum(axis=0), "u": x.T @ e, "c": e.sum(keepdims=True)}


def fit(texts: list[bytes], label: np.ndarray, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    net, rng = start(), np.random.Generator(np.random.PCG64(11))
    if len(label):
        rate = np.clip(label.mean(), 0.02, 0.98)
        net["c"][0] = np.log(rate / (1 - rate))
    m = {k: np.zeros_like(x) for k, x in net.items()}
    v = {k: np.zeros_like(x) for k, x in net.items()}
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        size, a = np.cumsum([len(texts[i]) for i in order]), 0
        while a < len(order):
            b = int(np.searchsorted(size, (size[a - 1] if a else 0) + BATCH_BYTES, "right"))
            some = order[a : min(a + BATCH, max(a + 1, b))]
            a += len(some)
            data = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
            text, hops = padded(data, np.cumsum([0, *(len(texts[i]) for i in some)]))
            t += 1
            for k, g in gradient(net, text, hops, label[some]).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                net[k] -= (RATE * (0.3 if epoch >= epochs - 2 else 1) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, label = [], []
    for batch in in_bound(batches):
        texts += [t.encode() for t in batch.column("text").to_pylist()]
        label += batch.column("label").to_pylist()
    if texts:
        net = fit(texts, np.array(label, np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([net[k].tobytes()], pa.binary()) for k in net], names=list(net))


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = {k: np.frombuffer(weights.value[k], np.float32).reshape(x.shape) for k, x in start().items()}
        for rows, data, offsets in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(predict(net, data, offsets))], names=["doc_id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bound: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    spark = docs.sparkSession
    rows = training_sample(docs, labels, "quality", sample).repartition(1).sortWithinPartitions("doc_id")
    fitted = rows.mapInArrow(_train, "w binary, b binary, u binary, c binary").first()
    net = {k: bytes(fitted[k]) if fitted else x.tobytes() for k, x in start().items()}
    weights = spark.sparkContext.broadcast(net)  # some 20 KB, whatever the input
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(_score(weights), "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= bound).cast("int").alias("predicted"))
