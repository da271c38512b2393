"""Language-model scores: a log-bilinear class model trained by noise-contrastive estimation.

Every word has a class: the most frequent words and the end token one each, all other words one by their
last bytes, so a word never seen has a class too. The log-bilinear model gives the class from the two
classes before; within a class, words share by add-one counts, with one slot for words never seen:

    p(word | context) = p(class | context) * (n(word) + 1) / (N_class + V_class + 1)

and 1 in place of the fraction for a class of one word. Both factors sum to one.

What is learned grows with the corpus. The number of classes follows the cube root of the distinct words
(``PER_ROOT`` a unit, up to ``MOST_CLASSES``, reached at about 130 million distinct words, which bounds the
broadcast tables to 38 MB). All texts are coded as class numbers once, with what of a score no training changes.
Training goes through every training token ``PASSES`` times: in each pass every partition of that table takes its
noise-contrastive steps from the common parameters, which are then averaged by tokens. Classes of all contexts are normalised by
one product of matrices, as the scores of a context are the sum of one term per class before.

The most frequent words (at most ``HEAD`` of at most ``LONGEST`` bytes) are broadcast with their counts; the
others of a document are joined with the count table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintflow.llm.common import id_text, remainder, slices, text_of, with_row
from stintflow.session import cut_lineage

PER_ROOT, MOST_CLASSES, LEAST_CLASSES = 6, 3072, 96
DIM, NOISE, BATCH, PASSES, RATE = 24, 32, 1024, 4, 0.15
MIXED_TOKENS = 1 << 18  # tokens that are shuffled together before they are cut into batches
MEANS = 64  # groups in which the partitions' parameters are summed before they come back
HEAD, LONGEST = 200_000, 64
END = b""  # no word is empty, so the end token can be
_FLUSH = 500_000
SLICE = 512  # texts scored together
LOT = 1 << 23  # characters of texts whose tokens are numbered together, each distinct word looked up once


@dataclass(frozen=True)
class Layout:
    """Classes ``0 .. own - 1`` are single words (the end token first), the ``tails`` after them are word endings."""

    own: int
    tails: int

    @property
    def size(self) -> int:
        return self.own + self.tails

    def tail(self, word: bytes) -> int:
        return self.own + ending(word) % self.tails


def layout_for(types: int) -> Layout:
    size = min(MOST_CLASSES, max(LEAST_CLASSES, math.ceil(PER_ROOT * types ** (1 / 3))))
    return Layout(size - size // 3, size // 3)


def ending(word: bytes) -> int:
    return crc32(word[-3:])


class Lookup(dict):
    """Index of a known word, or -1 - class of any other; answers for others are kept while there is room."""

    def __init__(self, known: dict[bytes, int], layout: Layout):
        super().__init__(known)
        self.own, self.tails, self.kept = layout.own, layout.tails, 0

    def __missing__(self, word: bytes) -> int:
        answer = -1 - self.own - ending(word) % self.tails
        if self.kept < _FLUSH:
            self.kept += 1
            self[word] = answer
        return answer


@dataclass(frozen=True)
class Tokens:
    """Tokens of several texts, each with its end, one after the other; ``at`` numbers each within ``distinct``."""

    lengths: np.ndarray
    words: pa.LargeBinaryArray
    at: np.ndarray

    @cached_property
    def distinct(self) -> list[bytes]:
        return self.words.to_numpy(zero_copy_only=False).tolist()

    @classmethod
    def of(cls, texts) -> Tokens:
        low = (text.encode("utf-8", "surrogatepass").lower().strip() for text in texts)
        # white space behind the last word leaves an empty word, the end token; the empty text is one empty word
        cut = pc.ascii_split_whitespace(pa.array([text and text + b" " for text in low], pa.large_binary()).view(pa.large_string()))
        coded = cut.flatten().dictionary_encode()
        return cls(pc.list_value_length(cut).to_numpy(), coded.dictionary.view(pa.large_binary()), coded.indices.to_numpy())

    def coded(self, lookup: Lookup, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and class per token."""
        index = np.fromiter(map(lookup.__getitem__, self.distinct), np.int64, len(self.distinct))
        return index[self.at], np.where(index >= 0, classes[np.maximum(index, 0)], -1 - index)[self.at]


def _lots(texts: list[str]):
    """Where texts that come to about ``LOT`` characters start and end."""
    lot = np.cumsum([len(text) for text in texts]) // LOT
    cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(texts)]
    return [(start, end) for start, end in zip(cuts, cuts[1:]) if start < end]


def _count_words(batches):
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for start, end in _lots(texts):
            tokens = Tokens.of(texts[start:end])
            yield pa.record_batch({"word": tokens.words.cast(pa.binary()), "n": np.bincount(tokens.at, minlength=len(tokens.words))})


def class_counts(texts: DataFrame) -> DataFrame:
    """``word, n, ending`` of all tokens, the end token as the empty word."""
    counted = texts.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return cut_lineage(counted.withColumn("ending", F.crc32(F.substring("word", -3, 3))))


def _code(shared):
    """Class numbers of every text, and what of its score no training changes."""

    def run(batches):
        known, classes, layout, logs = shared.value
        lookup = Lookup(known, layout)
        own = classes < layout.own
        for batch in (batch.iloc[start:end] for batch in batches for start, end in _lots(batch["text"])):
            tokens = Tokens.of(batch["text"])
            index, c = tokens.coded(lookup, classes)
            ends = np.cumsum(tokens.lengths)
            c, strange = c.astype("<u2"), index < 0
            words, out = tokens.words.take(pa.array(tokens.at[strange])).to_pylist(), []
            lost = np.concatenate([[0], np.cumsum(strange)])[np.concatenate([[0], ends])].tolist()
            for i, (start, end) in enumerate(zip((ends - tokens.lengths).tolist(), ends.tolist())):
                seen = index[start:end][~strange[start:end]]
                out.append((c[start:end].tobytes(), end - start, len(seen), float(logs[seen].sum()), float(logs[seen[own[seen]]].sum()), words[lost[i] : lost[i + 1]]))
            frame = pd.DataFrame(out, columns=["classes", "tokens", "n_known", "logs", "own_logs", "missing"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            frame.insert(1, "held_out", batch["held_out"].to_numpy())
            yield frame

    return run


CODED = "doc_id string, held_out boolean, classes binary, tokens bigint, n_known bigint, logs double, own_logs double, missing array<binary>"


def _before(coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second and first class before each token; a document begins as after two ends, whose class is 0."""
    padded = np.concatenate([[0, 0], coded])
    return padded[:-2], padded[1:-1]


def first_parameters(share: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Class vectors near zero and biases at the log shares: the unigram model of the classes."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    k = len(share)
    return {
        "R": small(k, DIM), "Q": small(k, DIM), "C1": np.eye(DIM, dtype=np.float32), "C2": 0.5 * np.eye(DIM, dtype=np.float32),
        "b": np.log(share).astype(np.float32),
    }


class Trainer:
    """Noise-contrastive estimation with Adagrad, one step per batch of tokens with the two classes before each."""

    def __init__(self, model: dict[str, np.ndarray], share: np.ndarray, seed: int):
        self.flat = np.concatenate([v.ravel() for v in model.values()])
        self.past, self.slope, self.room = np.full_like(self.flat, 1e-4), np.empty_like(self.flat), np.empty_like(self.flat)
        upto = np.cumsum([v.size for v in model.values()])[:-1]
        parts = lambda flat: {k: x.reshape(v.shape) for (k, v), x in zip(model.items(), np.split(flat, upto))}
        self.model, self.grads = parts(self.flat), parts(self.slope)  # as views
        self.rng = np.random.default_rng(seed)
        self.noise_upto = np.cumsum(share)
        self.shift = np.log(NOISE * share).astype(np.float32)
        self.cells = np.arange(len(share) * DIM).reshape(-1, DIM)
        self.tokens = 0

    def _scatter(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sum of the rows, given one after the other, that belong to each class."""
        flat = self.cells.take(at, axis=0).ravel()
        return np.bincount(flat, rows, self.cells.size).astype(np.float32).reshape(self.cells.shape)

    def step(self, c2: np.ndarray, c1: np.ndarray, c: np.ndarray, noise: np.ndarray) -> None:
        model, grads, k, n = self.model, self.grads, len(self.shift), len(c)
        hat = (model["R"] @ model["C1"]).take(c1, axis=0)
        hat += (model["R"] @ model["C2"]).take(c2, axis=0)
        q, qn, lift = model["Q"].take(c, axis=0), model["Q"].take(noise, axis=0), model["b"] - self.shift
        good = np.einsum("ij,ij->i", hat, q) + lift.take(c)
        fake = hat @ -qn.T
        fake -= lift.take(noise)
        up = (1 / (1 + np.exp(-good)) - 1) / n
        np.exp(fake, out=fake)
        fake += 1
        down = np.divide(np.float32(1 / n), fake, out=fake)
        dhat = down @ qn
        q *= up[:, None]
        dhat += q
        wide = dhat.ravel().astype(float)
        by_1, by_2 = self._scatter(c1, wide), self._scatter(c2, wide)
        by_c, db = grads["Q"], grads["b"]
        by_c[:] = self._scatter(c, (hat * up[:, None]).ravel())
        db[:] = np.bincount(c, up, k)
        np.add.at(by_c.ravel(), self.cells.take(noise, axis=0).ravel(), (down.T @ hat).ravel())  # a class may be drawn again
        np.add.at(db, noise, np.einsum("ij->j", down))
        np.matmul(by_1, model["C1"].T, out=grads["R"])
        grads["R"] += by_2 @ model["C2"].T
        np.matmul(model["R"].T, by_1, out=grads["C1"])
        np.matmul(model["R"].T, by_2, out=grads["C2"])
        g, past, room = self.slope, self.past, self.room
        past += np.multiply(g, g, out=room)
        g *= np.float32(RATE)
        g /= np.sqrt(past, out=room)
        self.flat -= g
        self.tokens += n

    @np.errstate(over="ignore")  # an infinite exponential gives a share of zero
    def learn(self, documents: list[np.ndarray]) -> None:
        """One step per ``BATCH`` tokens of the documents in random order; the last batch may be smaller."""
        c = np.concatenate(documents)
        c2, c1 = (x.copy() for x in _before(c))
        starts = np.cumsum([0, *map(len, documents)])[:-1]
        starts = starts[starts < len(c)]  # but for empty documents
        c1[starts] = c2[starts] = 0
        c2[starts[starts + 1 < len(c)] + 1] = 0
        order = self.rng.permutation(len(c))
        c2, c1, c = (x[order].astype(np.int64) for x in (c2, c1, c))
        steps = -(-len(c) // BATCH)
        drawn = np.searchsorted(self.noise_upto, self.rng.random(steps * NOISE) * self.noise_upto[-1], side="right")
        noise = np.minimum(drawn, len(self.shift) - 1).reshape(steps, NOISE)
        for each, at in zip(noise, range(0, len(c), BATCH)):
            self.step(c2[at : at + BATCH], c1[at : at + BATCH], c[at : at + BATCH], each)


def class_scores(model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the score by (first class before, class) and by (second class before, class)."""
    first = (model["R"] @ model["C1"]) @ model["Q"].T + model["b"]
    return first, (model["R"] @ model["C2"]) @ model["Q"].T


def log_sums(model: dict[str, np.ndarray]) -> np.ndarray:
    """Natural log of the sum of exponential scores by (second, first) class before, as one product of matrices."""
    first, second = (x.astype(float) for x in class_scores(model))
    top1, top2 = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
    sums = np.log(np.maximum(np.exp(second - top2) @ np.exp(first - top1).T, 1e-300))
    return (sums + top2 + top1.T).astype(np.float32)


def log_probabilities(first: np.ndarray, second: np.ndarray, sums: np.ndarray, coded: np.ndarray, starts=0) -> np.ndarray:
    """log10 probability of every class of a sequence after those before it. Of several sequences one after the
    other, ``starts`` are the first places; each ends with the end token, so only the second class before needs care."""
    c2, c1 = _before(coded)
    c2 = c2.copy()  # it shares its values with c1
    c2[starts] = 0
    return (first[c1, coded] + second[c2, coded] - sums[c2, c1]) / math.log(10)


@dataclass
class LanguageModel:
    tokens: int
    types: int
    counts: DataFrame
    known: dict[bytes, int]
    classes: np.ndarray
    layout: Layout
    logs: np.ndarray
    spread: np.ndarray
    model: dict[str, np.ndarray]
    coded: DataFrame


def _head(counts: DataFrame) -> pd.DataFrame:
    """The most frequent words: all at or above the least count that keeps them within ``HEAD``."""
    step = F.floor(F.log2("n") * 8)
    short = counts.where(F.length("word") <= LONGEST)
    sizes = sorted(((r["s"], r["k"]) for r in short.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    edge, total = None, 0
    for s, k in sizes:
        if total + k > HEAD:
            break
        edge, total = s, total + k
    if edge is None:
        return pd.DataFrame({"word": [], "n": []})
    head = short.where(step >= edge).select("word", "n").toPandas()
    head["word"] = [bytes(w) for w in head["word"]]
    return head.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def fit(texts: DataFrame) -> LanguageModel | None:
    """The model of a ``text`` column without nulls, from the rows that are not ``held_out`` if there is such a
    column; None if there is no row to learn from. All rows are coded, with their ``doc_id`` if there is one."""
    spark = texts.sparkSession
    for name, none in ("doc_id", F.lit(None).cast("string")), ("held_out", F.lit(False)):
        texts = texts if name in texts.columns else texts.withColumn(name, none)
    counts = class_counts(texts.where(~F.col("held_out")).select("text"))
    tokens, types = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not tokens:
        return None
    head = _head(counts)
    n, order = head["n"].to_numpy(np.int64), list(head["word"])
    layout = layout_for(types)
    own, k = layout.own, layout.size
    chosen = [END] + [w for w in order[:own] if w != END][: own - 1]
    number = {w: i for i, w in enumerate(chosen)}
    known = {w: i for i, w in enumerate(order)}
    if END not in known:
        n = np.append(n, counts.where(F.length("word") == 0).first()["n"])
        known[END] = len(order)
        order.append(END)
    classes = np.array([number[w] if w in number else layout.tail(w) for w in order], np.int64)

    per_class = np.zeros((k, 2))
    by_tail = counts.groupBy((F.col("ending") % layout.tails).alias("tail")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    for row in by_tail.collect():  # a row per class
        per_class[own + row["tail"]] = row["n"], row["v"]
    for word in chosen:
        per_class[layout.tail(word)] -= n[known[word]], 1
        per_class[number[word]] = n[known[word]], 1
    spread = np.where(np.arange(k) < own, 0.0, np.log10(per_class.sum(axis=1) + 1))
    share = (per_class[:, 0] + 0.5) / (tokens + 0.5 * k)

    logs = np.log10(n + 1.0)
    shared = spark.sparkContext.broadcast((known, classes, layout, logs))
    coded = with_row(texts.select("doc_id", "held_out", "text").mapInPandas(_code(shared), CODED))
    learned = coded.where(~F.col("held_out")).select("classes", "tokens")
    model = first_parameters(share)
    for turn in range(PASSES):
        model = _one_pass(learned, model, share, turn)
    return LanguageModel(int(tokens), int(types), counts, known, classes, layout, logs, spread, model, coded)


def _one_pass(coded: DataFrame, model: dict[str, np.ndarray], share: np.ndarray, turn: int) -> dict[str, np.ndarray]:
    """Parameters after every partition went through its tokens once, averaged by tokens; ``MEANS`` rows come back."""
    shared = coded.sparkSession.sparkContext.broadcast((model, share))
    names = sorted(model)

    def run(batches):
        part = TaskContext.get().partitionId()
        trainer = Trainer(*shared.value, turn * 1_000_003 + part)
        lot, held = [], 0
        for batch in slices(batches, 512):
            for raw in batch["classes"]:
                lot.append(np.frombuffer(raw, "<u2"))
                held += len(lot[-1])
                if held >= MIXED_TOKENS:
                    trainer.learn(lot)
                    lot, held = [], 0
        if lot:
            trainer.learn(lot)
        if trainer.tokens:
            flat = np.concatenate([trainer.model[k].ravel() for k in names]).astype(float) * trainer.tokens
            yield pd.DataFrame({"part": [part % MEANS], "n": [float(trainer.tokens)], "raw": [flat.tobytes()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["raw"].iloc[0]) // 8)
        for raw in rows["raw"]:
            total += np.frombuffer(raw, float)
        return pd.DataFrame({"n": [rows["n"].sum()], "raw": [total.tobytes()]})

    trained = coded.mapInPandas(run, "part bigint, n double, raw binary")
    sums = trained.groupBy("part").applyInPandas(add, "n double, raw binary").collect()
    flat = sum(np.frombuffer(row["raw"], float) for row in sums) / sum(row["n"] for row in sums)
    out, at = {}, 0
    for k in names:
        out[k] = flat[at : at + model[k].size].reshape(model[k].shape).astype(np.float32)
        at += model[k].size
    return out


def _score(shared):
    def run(batches):
        spread, model, sums = shared.value
        first, second = class_scores(model)
        for batch in slices(batches, SLICE):
            c = np.frombuffer(b"".join(batch["classes"]), "<u2").astype(np.int64)
            lengths = batch["tokens"].to_numpy()
            ends = np.cumsum(lengths)
            by_token = log_probabilities(first, second, sums, c, ends - lengths)
            apart = [
                float(by_token[start:end].sum(dtype=float)) - float(spread[c[start:end]].sum())
                for start, end in zip((ends - lengths).tolist(), ends.tolist())
            ]
            yield batch.drop(columns=["classes", "own_logs"]).assign(score=np.array(apart) + batch["logs"] - batch["own_logs"])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(F.col(id_col), 7) == 2


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows that are not held out train the model; all are scored. Both scores are log10 probabilities of the
    whole text with its end; ``base_score`` is that of add-one word counts. Null and empty texts hold the
    end alone. Without any training row both scores are 0, for the one slot that is left. Repeated rows
    count and score each; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(id_text(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    id_col = F.col("doc_id").cast(id_type).alias("doc_id")
    lm = fit(texts)
    if lm is None:
        size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint") + 1
        zero = F.lit(0.0)
        return texts.select(
            id_col, "held_out", size.alias("n_tokens"), F.lit(0).cast("bigint").alias("n_known"),
            F.lit(0).cast("bigint").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"),
        )
    shared = docs.sparkSession.sparkContext.broadcast((lm.spread, lm.model, log_sums(lm.model)))
    coded = lm.coded.select("_row", "doc_id", "held_out", "tokens", "n_known", "logs", "own_logs", "classes")
    schema = "_row bigint, doc_id string, held_out boolean, tokens bigint, n_known bigint, logs double, score double"
    rows = coded.mapInPandas(_score(shared), schema).withColumnRenamed("tokens", "n_tokens")
    rare = lm.coded.select("_row", F.explode("missing").alias("word"))
    log = F.log10(F.coalesce("n", F.lit(0)) + 1)
    found = (
        rare.join(lm.counts.select("word", "n"), "word", "left")
        .groupBy("_row")
        .agg(F.sum(log).alias("rare_logs"), F.count("n").alias("rare_known"))
    )
    more = F.coalesce("rare_logs", F.lit(0.0))
    each = math.log10(lm.tokens + lm.types + 1)
    return rows.join(found, "_row", "left").select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lm.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * each).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
