"""Quality classifier: attention-based multiple-instance learning on passages.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from its byte-pair profile
and a few counts; gated attention weighs the passages; the weighted mean is scored. Encoder, gates and
scorer are learned together in numpy from document labels alone.

The model is fitted in one task on at most ``max_docs`` labelled documents, the ones with the smallest
hash of their id; everything else reads all rows. The parameters (about 140 KB, whatever the input) are
the only thing that passes through the driver. Scoring is a column expression, so no row moves.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.llm.common import remainder, spans, text_of
from stintflow.llm.wordscan import Words, chunks

PASSAGE = 64
MAX_DOCS = 4096
HIDDEN, GATES = 32, 16
EPOCHS, BATCH, RATE = 8, 64, 3e-3
THRESHOLD = 0.3

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0, 9, 10, 11, 12, 13, 32]] = False
# byte classes: letters a-z, digits, white space, stops, other ASCII signs, capitals, bytes beyond ASCII
_CLASS = np.full(256, 29, np.int32)
_CLASS[ord("a") : ord("z") + 1] = np.arange(26)
_CLASS[ord("0") : ord("9") + 1] = 26
_CLASS[~NOT_SPACE] = 27
_CLASS[list(b".,;:!?")] = 28
_CLASS[ord("A") : ord("Z") + 1] = 30
_CLASS[128:] = 31
PAIRS, STATS = 32 * 32, 5


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair counts (one byte each), statistics, and the number of passages of each text, at least one."""
    scan = Words(texts, NOT_SPACE)
    per_doc = np.maximum(1, -(-scan.count // PASSAGE))
    base = np.cumsum(per_doc) - per_doc
    total = int(per_doc.sum())
    within = np.arange(len(scan.starts)) - scan.first[scan.doc]
    passage = base[scan.doc] + within // PASSAGE
    pairs = np.zeros((total, PAIRS), np.uint8)
    stats = np.zeros((total, STATS), np.float32)
    if not len(passage):
        return pairs, stats, per_doc
    codes = _CLASS[np.frombuffer(scan.data, np.uint8)]
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    last = np.append(first[1:], len(passage)) - 1
    lengths = scan.ends[last] - scan.starts[first]
    at = spans(scan.starts[first], lengths)
    owner = np.repeat(passage[first], lengths)
    # in lots of passages, so that the wide count array stays small
    lot = 2048
    for low in range(0, total, lot):
        part = slice(np.searchsorted(owner, low), np.searchsorted(owner, low + lot))
        code = (owner[part] - low) * PAIRS + codes[at[part]] * 32 + codes[at[part] + 1]
        size = min(lot, total - low)
        pairs[low : low + size] = np.minimum(np.bincount(code, minlength=size * PAIRS), 255).reshape(size, PAIRS)
    n = np.bincount(passage, minlength=total).astype(np.float32)
    hashes = scan.hashes()
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    keys = (passage.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    keys.sort()
    new = np.append(True, keys[1:] != keys[:-1])
    distinct = np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=total)
    size = np.bincount(passage, weights=scan.ends - scan.starts, minlength=total)
    some = np.maximum(n, 1)
    stats[:, 0] = distinct / some
    stats[:, 1] = np.bincount(passage, weights=same, minlength=total) / some
    stats[:, 2] = size / some / 10
    stats[:, 3] = n / PASSAGE
    stats[:, 4] = np.repeat(np.log1p(per_doc), per_doc) / 5
    return pairs, stats, per_doc


def features(pairs: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Square roots of the pair shares, beside the statistics."""
    wide = pairs.astype(np.float32)
    share = np.sqrt(wide / np.maximum(wide.sum(axis=1, keepdims=True), 1))
    return np.concatenate([share, stats], axis=1)


def forward(model: dict[str, np.ndarray], x: np.ndarray, per_doc: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of the documents and what lies on the way to them."""
    at = np.cumsum(per_doc) - per_doc
    x = (x - model["mean"]) / model["scale"]
    h = np.tanh(x @ model["W"] + model["b"])
    t = np.tanh(h @ model["V"])
    s = 1 / (1 + np.exp(-(h @ model["U"])))
    e = (t * s) @ model["w"]
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, at), per_doc))
    a /= np.repeat(np.add.reduceat(a, at), per_doc)
    z = np.add.reduceat(a[:, None] * h, at)
    logit = np.clip(z @ model["c"] + model["d"], -30, 30)
    return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-logit))}


def gradients(model: dict[str, np.ndarray], f: dict[str, np.ndarray], per_doc: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss."""
    at = np.cumsum(per_doc) - per_doc
    err = (f["p"] - y) / len(y)
    dz = np.repeat(err[:, None] * model["c"], per_doc, axis=0)
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at), per_doc))
    dt = de[:, None] * model["w"] * f["s"] * (1 - f["t"] ** 2)
    ds = de[:, None] * model["w"] * f["t"] * f["s"] * (1 - f["s"])
    dh = f["a"][:, None] * dz + dt @ model["V"].T + ds @ model["U"].T
    dh *= 1 - f["h"] ** 2
    return {
        "c": f["z"].T @ err,
        "d": np.array(err.sum()),
        "w": (f["t"] * f["s"]).T @ de,
        "V": f["h"].T @ dt,
        "U": f["h"].T @ ds,
        "W": f["x"].T @ dh,
        "b": dh.sum(axis=0),
    }


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit by Adam on whole documents. Without both classes the score is the smoothed share of label 1."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    width = PAIRS + STATS
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    model = {
        "W": draw(width, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES),
        "w": draw(GATES), "c": draw(HIDDEN), "d": np.zeros((), np.float32),
        "mean": np.zeros(width, np.float32), "scale": np.ones(width, np.float32),
    }
    share = (y.sum() + 1) / (len(y) + 2)
    model["d"] = np.float32(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        model["c"] = np.zeros(HIDDEN, np.float32)
        return model
    bags = [encode_passages(part) for _, part in chunks([t.encode("utf-8", "surrogatepass") for t in texts])]
    pairs, stats, per_doc = (np.concatenate(part) for part in zip(*bags))
    first = np.cumsum(per_doc) - per_doc
    picked = rng.choice(len(pairs), min(len(pairs), 8192), replace=False)
    x = features(pairs[picked], stats[picked])
    model["mean"], model["scale"] = x.mean(axis=0), x.std(axis=0) + 0.02
    names = ("W", "b", "V", "U", "w", "c", "d")
    moment = {n: np.zeros_like(model[n]) for n in names}
    square = {n: np.zeros_like(model[n]) for n in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(order), BATCH):
            docs = order[low : low + BATCH]
            rows = spans(first[docs], per_doc[docs])
            f = forward(model, features(pairs[rows], stats[rows]), per_doc[docs])
            step += 1
            for n, g in gradients(model, f, per_doc[docs], y[docs]).items():
                g = g + 1e-4 * model[n]
                moment[n] = 0.9 * moment[n] + 0.1 * g
                square[n] = 0.999 * square[n] + 0.001 * g * g
                move = (moment[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.999**step)) + 1e-8)
                model[n] = (model[n] - RATE * move).astype(np.float32)
    return model


def pack(model: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as data:
        return {n: data[n] for n in data.files}


def score_texts(model: dict[str, np.ndarray], texts: list[str]) -> np.ndarray:
    scores = np.zeros(len(texts))
    for base, part in chunks([t.encode("utf-8", "surrogatepass") for t in texts]):
        pairs, stats, per_doc = encode_passages(part)
        scores[base : base + len(part)] = forward(model, features(pairs, stats), per_doc)["p"]
    return scores


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS
) -> dict[str, np.ndarray]:
    """The model, fitted on the labelled documents given; the caller holds back what must not be learned.

    Several labels of one id count by their mean, at 0.5 and above as 1; null labels and null ids are left
    out. Null texts are empty ones. Without labels the score is 0.5 throughout.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    # at most max_docs pairs of numbers, so they may be broadcast
    sample = texts.join(F.broadcast(chosen), "doc_id").repartition(1).sortWithinPartitions("doc_id", "text")

    def run(batches):
        rows = [(t, y) for batch in batches for t, y in zip(batch["text"], batch["y"])]
        yield pd.DataFrame({"model": [pack(train([t for t, _ in rows], np.array([y for _, y in rows])))]})

    fitted = sample.select("text", "y").mapInPandas(run, "model binary").first()
    return unpack(fitted["model"]) if fitted else train([], np.zeros(0))


def quality_score(model: dict[str, np.ndarray], text: Column, spark) -> Column:
    """The score of a text column, 0 to 1; null and empty texts are bags of one empty passage."""
    shared = spark.sparkContext.broadcast(pack(model))
    loaded = {}

    @F.pandas_udf("double")
    def score(batches: pd.Series) -> pd.Series:
        if not loaded:
            loaded.update(unpack(shared.value))
        return pd.Series(score_texts(loaded, ["" if t is None else t for t in batches]))

    return score(F.coalesce(text, F.lit("")))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the registered query never learns from."""
    return remainder(F.col(id_col), 5) == 0


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` with ``_score`` and ``_good`` (score at or above the threshold).

    Labels are learned only where ``held_out`` is false. Repeated rows and null ids are scored like others;
    an empty table gives no rows.
    """
    model = fit_quality(docs, labels.where(~held_out(id_col)), id_col, text_col)
    scored = docs.withColumn("_score", quality_score(model, F.col(text_col), docs.sparkSession))
    return scored.withColumn("_good", F.col("_score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at or above the threshold, all columns as they are."""
    model = fit_quality(docs, labels.where(~held_out(id_col)), id_col, text_col)
    return docs.where(quality_score(model, F.col(text_col), docs.sparkSession) >= threshold)
