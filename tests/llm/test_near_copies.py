"""The pipeline's near-duplicate stage beside all pairs in plain Python."""

import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from stintflow.llm import near_copies, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars int"


def shingles(text):
    w = WORD.findall((text or "").lower())
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept_by_hand(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return sorted(min(g) for g in groups.values())


def planted():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, texts = " ".join(prose(30)), []
    for _ in range(40):
        base = prose(rng.randint(60, 200))
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 5):  # similarities on both sides of 0.8
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = "zz" + copy[at]
            texts.append(" ".join(copy))
    hot = prose(150)
    for k in range(60):
        copy = list(hot)
        copy[2 * k] = f"v{k}"
        texts.append(" ".join(copy))
    chain = prose(300)
    texts += [" ".join(chain[12 * k : 12 * k + 180]) for k in range(8)]
    texts += [" ".join(prose(40)) + " " + common for _ in range(30)]
    texts += ["", None, " \n", "one two", "ONE  two", "one two three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_dedup_finds_every_copy_of_four_fifths(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "s", "en", len(t or "")) for i, t in rows], SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == kept_by_hand(rows)
    assert simhash.keep_one(docs).count() > got.count()


def test_near_dedup_ids_and_repeats(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(7, text), (7, text), (None, text), (9, text.replace("w50", "x")), (None, "other words"), (2**60 + 1, "third text")]
    docs = spark.createDataFrame([(i, t, "s", "en", 0) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(7, text), (None, "other words"), (2**60 + 1, "third text")], key=str)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def prose(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_links_are_found_through_fingerprints(spark):
    """Without near fingerprints nothing links, and a group of near copies leaves a forest, not its pairs."""
    base = prose(3, 150)
    texts = [" ".join([*base[: 2 * k], f"v{k}", *base[2 * k + 1 :]]) for k in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("text_key", F.xxhash64("text"))
    sets = [near_copies.shingle_set(t) for t in texts]
    heads = lambda fp: spark.createDataFrame(
        [(near_copies._set_key(s), r.text_key, len(s), bytearray(fp(s))) for s, r in zip(sets, docs.orderBy("doc_id").collect())],
        "set_key bigint, text_key bigint, n int, fp binary",
    )
    texts = docs.select("text", "text_key")
    for tile in (near_copies.TILE, 8):
        links = near_copies.similar_links(texts, heads(near_copies.fingerprint), tile).collect()
        met = 1 if tile > 60 else 60 // tile + 2
        assert 59 <= len(links) <= 60 * met * 2
    far = iter(range(60))
    assert near_copies.similar_links(texts, heads(lambda s: random.Random(next(far)).randbytes(32))).count() == 0


def test_fingerprints_reach_four_fifths():
    missed = 0
    for seed in range(300):
        size = random.Random(seed).choice([9, 40, 90, 400])
        x = near_copies.shingle_set(" ".join(prose(seed, size + 4)))
        y = np.unique(np.concatenate([x[: -(size // 9)], near_copies.shingle_set(" ".join(prose(seed + 1000, size // 9 + 4)))]))
        codes = near_copies._codes(near_copies.fingerprint(x) + near_copies.fingerprint(y))
        missed += not near_copies._near(codes[:, :1], len(x), codes[:, 1:], np.array([len(y)]))[0]
    assert missed <= 1
