"""Source divergence, vector codes and embedding links beside brute force, on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintflow.llm import ball_codes, divergence, projection_links
from stintflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, term string, block int, gid string, p double, counts int, rank int"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def divergence_by_hand(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = WORD.findall(lower(text or ""))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= least) for lang in {g[0] for g in groups}}
    whole = {lang: sum((counts[g] for g in groups if g[0] == lang), Counter()) for lang in kept}

    def shares(counter, lang):
        n, v = sum(counter[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (counter[t] + 5) // (n + 5 * v) for t in kept[lang]}

    out = []
    for lang, source in groups:
        mine, all_of = shares(counts[lang, source], lang), shares(whole[lang], lang)
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            theirs = shares(counts[lang, other], lang)
            pairs.append((-sum(abs(mine[t] - theirs[t]) for t in kept[lang]), other.encode(), other))
        terms = [(-(mine[t] - all_of[t]), t.encode(), t) for t in kept[lang] if counts[lang, source][t] and mine[t] > all_of[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(out)


def documents(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeXYéßñ语") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    rows = []
    for i in range(220):
        words = [rng.choice(vocabulary[: 20 + 10 * (i % 5)]) for _ in range(rng.randint(0, 30))]
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", "É", None, ""])
        rows.append((rng.choice([" ", "1", "_\n", "\x00"]).join(words), rng.choice(["en", "en", "de", None]), source))
    rows += rows[:5]
    rows += [(None, "en", "empty"), ("", "xx", "one"), (" 12 \n", "xx", "two"), ("Alone", None, "s1")]
    rows.append((" ".join(rng.choice(vocabulary) for _ in range(50000)), "en", "long"))
    rows.append(("a" * 200000, "de", "s2"))
    return rows


def frame(spark, rows):
    wide = [(i, *r, "t", 1, "g", 0.5, 2, 3) for i, r in enumerate(rows)]
    return spark.createDataFrame(wide, DOCS)


@pytest.mark.parametrize(("entries", "text_bytes"), [(divergence.ENTRIES, divergence.TEXT_BYTES), (40, 1 << 20), (1 << 20, 500)])
def test_divergence_by_hand(spark, entries, text_bytes):
    rows = documents()
    got = divergence.source_divergence(frame(spark, rows).repartition(5), least=4, top=7, entries=entries, text_bytes=text_bytes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_by_hand(rows, 4, 7)


def test_divergence_over_blocks_of_sources(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(" ".join(rng.choice("a b c d e f g h i j k l".split()) for _ in range(rng.randint(0, 12))), "en", f"s{rng.randrange(40)}") for _ in range(400)]
    monkeypatch.setattr(divergence, "SOURCES", 8)
    monkeypatch.setattr(divergence, "TERMS", 4)
    assert sorted(map(tuple, divergence.source_divergence(frame(spark, rows), least=3).collect())) == divergence_by_hand(rows, 3, 50)


def test_divergence_without_rows_or_terms(spark):
    assert divergence.source_divergence(frame(spark, []).limit(0)).count() == 0
    rows = [("a b", "en", "x"), ("c", "en", "y"), (None, None, None)]
    assert sorted(map(tuple, divergence.source_divergence(frame(spark, rows)).collect())) == divergence_by_hand(rows, 30, 50)


def test_shares_beyond_a_long(spark):
    count, total = 7 * 10**12, 9 * 10**12 + 13
    row = spark.range(1).select(F.lit(count).alias("c"), F.lit(total).alias("t")).select(divergence.share("c", "t").alias("s"), divergence.share("c", "t - t").alias("z")).first()
    assert row.s == 1 + 10**9 * (count + 5) // total and row.z is None


def test_corrections_against_dense_sums():
    rng = np.random.default_rng(1)
    p, q = rng.integers(1, 50, 3), rng.integers(1, 50, 4)
    no_x, no_y = rng.random((9, 3)) < 0.6, rng.random((9, 4)) < 0.6
    x, y = np.where(no_x, p, rng.integers(1, 99, (9, 3))), np.where(no_y, q, rng.integers(1, 99, (9, 4)))
    want = np.abs(x[:, :, None] - y[:, None, :]).sum(axis=0) - 9 * np.abs(p[:, None] - q[None])
    assert (divergence._shift(x, y, p, q, (no_x, no_y)) == want).all()


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error int, key int, node string, weight int"


def vectors(n=700, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(n // 3, n // 2):
        base[i] = base[i - n // 3] + rng.normal(size=dim).astype(np.float32) * np.float32(rng.choice([0, 0.02, 0.05, 0.08]))
    rows = [(int(i), base[i].tolist(), int(i % 7) if i % 31 else None) for i in rng.permutation(n)]
    rows += [(n + k, base[0].tolist(), 0) for k in range(60)]
    rows += [(2**60 + 1, base[1].tolist(), 1), (5, base[5].tolist(), 5), (5, base[6].tolist(), 5)]
    rows += [(9001, None, 1), (9002, [None] * dim, 1), (9003, [float("nan")] + [1.0] * (dim - 1), 1), (9004, [float("inf")] * dim, 2)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, "n", 3) for r in rows], VECTORS)


def finite(vec):
    return vec is not None and all(x is not None and np.isfinite(x) for x in vec)


def codes_by_hand(rows, rounds=ball_codes.ROUNDS):
    rows = sorted((r for r in rows if finite(r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.floor(np.array([r[1] for r in rows], np.float64) * 4096).astype(np.int64).reshape(len(rows), 8, -1)
    centres = x[:16].transpose(1, 0, 2).copy()

    def assign():
        gaps = ((x[:, :, None, :] - centres[None]) ** 2).sum(axis=-1)
        return gaps.argmin(axis=-1), gaps.min(axis=-1)

    for _ in range(rounds):
        codes, _gaps = assign()
        for p in range(8):
            for e in range(centres.shape[1]):
                mine = x[codes[:, p] == e, p]
                if len(mine):
                    centres[p, e] = mine.sum(axis=0) // len(mine)
    codes, gaps = assign()
    error = gaps.sum(axis=1)
    out = [(r[0], r[2], "".join(f"{c:02x}" for c in codes[i]), int(error[i])) for i, r in enumerate(rows)]
    return out, hashlib.sha256(",".join(map(str, centres.ravel().tolist())).encode()).hexdigest()


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("n", [5, 16, 700])
def test_codes_by_hand(spark, n):
    rows = [*vectors()[:n], (None, [0.5] * 16, 3)] if n < 700 else [*vectors(), (None, [0.5] * 16, 3)]
    coded, centres = ball_codes.ball_codes(vector_frame(spark, rows).repartition(3))
    want, digest = codes_by_hand(rows)
    assert sorted_rows(map(tuple, coded.collect())) == sorted_rows(want)
    assert ball_codes.codebooks_digest(centres) == digest
    total = Counter()
    for _, label, _, error in want:
        total[label] += error
    assert all(r.label_error == total[r.label] for r in ball_codes.with_label_error(coded).collect())


def test_rings_lose_no_candidate():
    rng = np.random.default_rng(2)
    for scale in (2, 40, 10**7):
        points, centres = rng.integers(-scale, scale + 1, (500, 3)), rng.integers(-scale, scale + 1, (16, 3))
        gaps = ((points[:, None] - centres[None]) ** 2).sum(axis=-1)
        for codes in (None, rng.integers(0, 16, 500).astype(np.uint8), gaps.argmin(axis=1).astype(np.uint8)):
            radius = np.zeros(16)
            if codes is not None:
                np.maximum.at(radius, codes, np.sqrt(((points - centres[codes]) ** 2).sum(axis=-1)))
            got, own = ball_codes.nearest(points, centres, codes, None if codes is None else radius)
            assert (got == gaps.argmin(axis=1)).all() and (own == gaps.min(axis=1)).all()


def test_codes_without_rows_and_of_odd_lengths(spark):
    coded, centres = ball_codes.ball_codes(vector_frame(spark, [(1, None, 1), (2, [None], 1)]))
    assert coded.count() == 0 and centres is None and coded.columns == ["vec_id", "label", "code", "error"]
    with pytest.raises(Exception, match="length"):
        ball_codes.ball_codes(vector_frame(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)]))[0].collect()
    with pytest.raises(Exception, match="no code"):
        ball_codes.ball_codes(vector_frame(spark, [(1, [1e30] * 8, 1)]))[0].collect()


def links_by_hand(rows, cosine=0.98):
    ok = [finite(r[1]) and r[2] is not None and any(r[1]) for r in rows]
    unit = [np.array(r[1], np.float64) / np.linalg.norm(np.array(r[1], np.float64)) if o else None for r, o in zip(rows, ok)]
    near = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                near[i].append(j), near[j].append(i)
    least = [r[0] if r[0] is not None else float("inf") for r in rows]
    moved = True
    while moved:
        new = [min([least[i], *(least[j] for j in near[i])]) for i in range(len(rows))]
        moved, least = new != least, new
    ids = [None if x == float("inf") else x for x in least]
    return [(r[0], len(near[i]), ids[i], r[0] == ids[i]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("tile", [16, projection_links.TILE])
def test_links_by_hand(spark, tile):
    rows = [*vectors(), (9100, [0.0] * 16, 1), (9101, [], 1), (9102, [2.0] * 8, 1), (9103, [3.0] * 8, 1), (None, [1e30] * 16, 6), (9104, [1e-30] * 16, 6)]
    got = projection_links.near_vectors(vector_frame(spark, rows).repartition(3), tile=tile)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = sorted_rows(map(tuple, got.collect())), sorted_rows(links_by_hand(rows))
    assert len(got) == len(want)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert sum(g == w for g, w in zip(got, want)) >= 0.99 * len(want)


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.01).tolist(), 1) for i in range(900)]
    got = projection_links.near_vectors(vector_frame(spark, rows), tile=128).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(899, 0)}


def test_links_without_rows(spark):
    assert projection_links.near_vectors(vector_frame(spark, []).limit(0)).count() == 0


def test_threshold_keeps_the_recall():
    rng = np.random.default_rng(6)
    draws = np.abs(rng.normal(size=(200000, projection_links.PROJECTIONS))) <= projection_links.WINDOW
    least = projection_links.threshold()
    assert (draws.sum(axis=1) >= least).mean() >= projection_links.RECALL - 5e-4
    assert (draws.sum(axis=1) >= least + 1).mean() < projection_links.RECALL


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_embedding_near_dedup"])
def test_one_row_per_vector(spark, name):
    want = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(r.vec_id for r in QUERIES[name](spark, SF).collect()) == sorted(want)
