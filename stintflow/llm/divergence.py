"""How far the sources of a language lie apart in their words, by single-pass in-memory indexing.

Every task counts its documents into a block of postings (term, source, count) in memory. When the block is full
it is spilled as a run: sorted by term, dealt to shards by the term's hash, cut into chunks. A shard's chunks arrive
sorted by their first term and are merged through a heap that holds one open chunk per run, into the frequency of
each term per source. Terms kept by enough documents then have an exact whole-number share in each source.

The distance of two sources is a sum over all kept terms. It starts from the share of an absent term, times all
terms, and is put right only for the terms that occur in one of the two: these corrections are summed while a
block of sources meets another, term by term, so neither the vocabulary nor the sources of a language have to fit
into one task, and pairs of sources are never formed per term.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintflow.llm.common import text_of
from stintflow.scale import top_k
from stintflow.session import cut_lineage

LEAST_DOCS = 30
SHARE = 1_000_000_000
PLUS = 5
TOP = 50
# What a block holds before it is spilled: entries of its counters, and bytes of text that went into it.
ENTRIES = 1 << 20
TEXT_BYTES = 1 << 27
CHUNK = 1 << 10  # postings of a chunk of a run, but for a term of more sources
SOURCES = 256  # sources that meet as one block
TERMS = 512  # terms of a block pair that are corrected by one task
# ASCII letters become lower case, bytes of other letters stay, all else separates.
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

_RUN = pa.schema(
    [
        ("shard", pa.int32()),
        ("lang", pa.binary()),
        ("first", pa.binary()),
        ("terms", pa.binary()),
        ("docs", pa.binary()),
        ("sizes", pa.binary()),
        ("sources", pa.list_(pa.binary())),
        ("source", pa.binary()),
        ("counts", pa.binary()),
    ]
)
_RUN_DDL = (
    "shard int, lang binary, first binary, terms binary, docs binary, sizes binary, sources array<binary>, "
    "source binary, counts binary"
)
_FREQUENCY = pa.schema(
    [("lang", pa.binary()), ("term", pa.binary()), ("sources", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))]
)
_FREQUENCY_DDL = "lang binary, term binary, sources array<binary>, counts array<bigint>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _run(counts: dict, docs: dict, shards: int):
    """The block as chunks of a run: per language and shard, terms ascending."""
    for lang, seen in docs.items():
        terms = sorted(seen)
        place = dict(zip(terms, range(len(terms))))
        shard = np.fromiter(map(crc32, terms), np.int64, len(terms)) % shards
        sources = sorted(s for of, s in counts if of == lang)
        held = [counts[lang, s] for s in sources]
        term = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in held])
        count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in held])
        source = np.repeat(np.arange(len(held), dtype=np.int32), [len(c) for c in held])
        order = np.lexsort((source, term, shard[term]))
        source, count = source[order], count[order]
        line = np.argsort(shard, kind="stable")
        sizes = np.bincount(term, minlength=len(terms))[line]
        ends = np.cumsum(sizes)
        lot = np.stack([shard[line], ends // CHUNK])
        cuts = np.flatnonzero((lot[:, 1:] != lot[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(line)]):
            mine = [terms[i] for i in line[a:b]]
            low, high = int(ends[a] - sizes[a]), int(ends[b - 1])
            used, local = np.unique(source[low:high], return_inverse=True)
            yield {
                "shard": int(shard[line[a]]),
                "lang": lang,
                "first": mine[0],
                "terms": b" ".join(mine),
                "docs": np.fromiter(map(seen.__getitem__, mine), np.int64, len(mine)).tobytes(),
                "sizes": sizes[a:b].astype(np.int32).tobytes(),
                "sources": [sources[i] for i in used],
                "source": local.astype(np.int32).tobytes(),
                "counts": count[low:high].tobytes(),
            }


def _batches(rows, schema: pa.Schema, size: int):
    lot = []
    for row in rows:
        lot.append(row)
        if len(lot) == size:
            yield pa.RecordBatch.from_pylist(lot, schema)
            lot = []
    if lot:
        yield pa.RecordBatch.from_pylist(lot, schema)


def _index(shards: int, entries: int, text_bytes: int):
    """Documents to runs."""

    def rows(batches):
        counts, docs = defaultdict(Counter), defaultdict(Counter)
        held = size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                found = terms_of(text)
                if not found:
                    continue
                for counter, words in ((counts[lang, source], found), (docs[lang], set(found))):
                    before = len(counter)
                    counter.update(words)
                    held += len(counter) - before
                size += len(text)
                if held >= entries or size >= text_bytes:
                    yield from _run(counts, docs, shards)
                    counts, docs = defaultdict(Counter), defaultdict(Counter)
                    held = size = 0
        yield from _run(counts, docs, shards)

    return lambda batches: _batches(rows(batches), _RUN, 64)


class _Chunk:
    """A chunk of a run, read one term after the other; ``key`` is where it stands."""

    def __init__(self, row: dict):
        self.head = (row["shard"], row["lang"])
        self.terms = row["terms"].split(b" ")
        self.docs = np.frombuffer(row["docs"], np.int64).tolist()
        self.ends = np.cumsum(np.frombuffer(row["sizes"], np.int32)).tolist()
        self.sources, self.source, self.counts = row["sources"], row["source"], row["counts"]
        self.at = 0
        self.key = (*self.head, self.terms[0])

    def step(self) -> bool:
        self.at += 1
        if self.at == len(self.terms):
            return False
        self.key = (*self.head, self.terms[self.at])
        return True

    def postings(self, at: int):
        low, high = self.ends[at - 1] if at else 0, self.ends[at]
        source = np.frombuffer(self.source, np.int32)[low:high].tolist()
        counts = np.frombuffer(self.counts, np.int64)[low:high].tolist()
        return zip([self.sources[s] for s in source], counts)

    def __lt__(self, other: "_Chunk") -> bool:
        return self.key < other.key


def _merge(least: int):
    """Chunks sorted by shard, language and first term to the frequencies of terms in ``least`` documents or more."""

    def closed(met):
        if not met or sum(chunk.docs[at] for chunk, at in met) < least:
            return
        total = Counter()
        for chunk, at in met:
            for source, count in chunk.postings(at):
                total[source] += count
        chunk, at = met[0]
        yield {"lang": chunk.head[1], "term": chunk.terms[at], "sources": list(total), "counts": list(total.values())}

    def rows(batches):
        heap, met, key = [], [], None

        def below(limit):
            """Terms that no chunk still to come can hold, in order; ``met`` keeps the last one's postings."""
            nonlocal met, key
            while heap and (limit is None or heap[0].key < limit):
                top = heap[0]
                if top.key != key:
                    yield from closed(met)
                    met, key = [], top.key
                met.append((top, top.at))
                if top.step():
                    heapq.heapreplace(heap, top)
                else:
                    heapq.heappop(heap)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    yield from below((row["shard"], row["lang"], row["first"]))
                    heapq.heappush(heap, _Chunk(row))
        yield from below(None)
        yield from closed(met)

    return lambda batches: _batches(rows(batches), _FREQUENCY, 1024)


def term_frequencies(docs: DataFrame, least: int = LEAST_DOCS, entries: int = ENTRIES, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """``lang, term, sources, counts`` of each term that occurs in ``least`` documents of its language or more."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = 4 * parts
    # read as bytes, so that no text can fail to decode
    raw = docs.select(*[text_of(c).cast("string").cast("binary").alias(c) for c in ("lang", "source", "text")])
    runs = raw.mapInArrow(_index(shards, entries, text_bytes), _RUN_DDL)
    dealt = runs.repartition(parts, "shard").sortWithinPartitions("shard", "lang", "first")
    found = dealt.mapInArrow(_merge(least), _FREQUENCY_DDL)
    return found.select(
        F.col("lang").cast("string"),
        F.col("term").cast("string"),
        F.transform("sources", lambda s: s.cast("string")).alias("sources"),
        "counts",
    )


def share(count: str, total: str) -> Column:
    """``1 + floor(SHARE * (count + PLUS) / total)``; the product may exceed a long, a decimal holds it."""
    return F.expr(f"1 + CAST({count} + {PLUS} AS DECIMAL(20, 0)) * {SHARE} div nullif({total}, 0)")


def source_stats(docs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """A row per occurring ``(lang, source)``: ``gid``, its words ``n``, those of the language ``n_lang``, the
    language's kept terms ``v``, the share ``p0`` of a term that the source lacks, and the ``block`` of the source."""
    spread = frequencies.select("lang", F.inline(F.arrays_zip("sources", "counts"))).toDF("lang", "source", "count")
    words = spread.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    inside = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    langs = frequencies.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(inside).alias("n_lang"))
    groups = docs.select(text_of("lang").cast("string").alias("lang"), text_of("source").cast("string").alias("source")).distinct()
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = groups.join(sizes, "lang").join(words, ["lang", "source"], "left").join(langs, "lang", "left")
    block = F.pmod(F.xxhash64("source"), F.ceil(F.col("n_sources") / SOURCES)).cast("int").alias("block")
    numbered = joined.select("lang", "source", "n_sources", block, zero("n"), zero("n_lang"), zero("v"))
    numbered = numbered.withColumn("p0", share("0", f"n + {PLUS} * v"))
    return cut_lineage(numbered.withColumn("gid", F.monotonically_increasing_id()))


def _shift(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, absent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Over terms (rows), ``|x - y|`` less ``|p - q|`` of each pair of columns in which one of the two has the term.

    ``x, y`` are shares per term and source, ``p, q`` those of an absent term, ``absent`` where a term is.
    """
    base = np.abs(p[:, None] - q[None, :])
    out = np.zeros(base.shape, np.int64)
    no_x, no_y = absent
    for g in range(x.shape[1]):
        rows = np.flatnonzero(~no_x[:, g])
        out[g] += np.abs(x[rows, g][:, None] - y[rows]).sum(axis=0) - len(rows) * base[g]
    for h in range(y.shape[1]):
        rows = np.flatnonzero(~no_y[:, h])
        alone = no_x[rows]
        out[:, h] += (np.abs(x[rows] - y[rows, h][:, None]) * alone).sum(axis=0) - alone.sum(axis=0) * base[:, h]
    return out


class _Side:
    """The sources of one block and their shares in the terms met since the last correction."""

    def __init__(self, gids: list[int], shares: list[int]):
        order = np.argsort(gids)
        self.gids = np.asarray(gids, np.int64)[order]
        self.p0 = np.asarray(shares, np.int64)[order]
        self.clear()

    def clear(self) -> None:
        self.p = np.tile(self.p0, (TERMS, 1))
        self.absent = np.ones(self.p.shape, bool)

    def put(self, row: int, gids: list[int], shares: list[int]) -> None:
        at = np.searchsorted(self.gids, gids)
        self.p[row, at] = shares
        self.absent[row, at] = False


def _pair_sums(left: _Side, right: _Side, used: int) -> np.ndarray:
    absent = (left.absent[:used], right.absent[:used])
    return _shift(left.p[:used], right.p[:used], left.p0, right.p0, absent)


def _frame(left: _Side, right: _Side, total: np.ndarray) -> pa.RecordBatch:
    i, j = np.nonzero(total)
    u, v, d = left.gids[i], right.gids[j], total[i, j]
    if left is not right:
        u, v, d = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([d, d])
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d)], ["gid", "other", "delta"])


def _correct(batches):
    """Per pair of blocks: their sources (rows without a term come first), then shares term by term."""
    key, sides, total, used, term = None, {}, None, 0, None

    def ends():
        left, right = sides[key[1]], sides[key[2]]
        return left, right, total + _pair_sums(left, right, used)

    for batch in batches:
        names = ("lid", "a", "b", "slice", "block", "term", "gids", "shares")
        for lid, a, b, part, block, word, gids, shares in zip(*(batch.column(c).to_pylist() for c in names)):
            if (lid, a, b, part) != key:
                if total is not None:
                    yield _frame(*ends())
                key, sides, total, used, term = (lid, a, b, part), {}, None, 0, None
            if word is None:
                sides[block] = _Side(gids, shares)
                continue
            if total is None:
                total = np.zeros((len(sides[a].p0), len(sides[b].p0)), np.int64)
            if word != term:
                if used == TERMS:
                    left, right, total = ends()
                    left.clear(), right.clear()
                    used = 0
                term, used = word, used + 1
            sides[block].put(used - 1, gids, shares)
    if total is not None:
        yield _frame(*ends())


def _pair_corrections(shares: DataFrame, stats: DataFrame) -> DataFrame:
    """``gid, other, delta`` over ordered pairs of sources of one language."""
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    langs = stats.where("v > 0").groupBy("lang").agg(
        F.min("gid").alias("lid"),
        F.ceil(F.max("n_sources") / SOURCES).cast("int").alias("blocks"),
        F.ceil(F.max("v") / TERMS).alias("slices"),
    )
    kept = langs.join(stats, "lang").groupBy("lid", "block", "blocks", "slices")
    listed = lambda value: F.sort_array(F.collect_list(F.struct("gid", F.col(value).alias("p")))).alias("held")
    heads = kept.agg(listed("p0")).select(
        "*", F.lit(None).cast("binary").alias("term"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice")
    )
    lines = langs.join(shares, "lang").groupBy("lid", "block", "blocks", "slices", "term").agg(listed("p")).select(
        "lid", "block", "blocks", "slices", "held", F.col("term").cast("binary"), F.pmod(F.xxhash64("term"), "slices").alias("slice")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = heads.unionByName(lines).select("*", other).select(
        "lid",
        F.least("block", "other").alias("a"),
        F.greatest("block", "other").alias("b"),
        "slice",
        "block",
        "term",
        F.col("held.gid").alias("gids"),
        F.col("held.p").alias("shares"),
    )
    dealt = met.repartition(parts, "lid", "a", "b", "slice").sortWithinPartitions("lid", "a", "b", "slice", "term", "block")
    found = dealt.mapInArrow(_correct, "gid bigint, other bigint, delta bigint")
    return found.groupBy("gid", "other").agg(F.sum("delta").alias("delta"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, entries: int = ENTRIES, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances of sources and what sets each apart.

    Part ``pair`` has a row per other source of the language, part ``term`` the ``top`` terms whose share in the
    source exceeds that in the language most. Nulls in text, lang and source are the empty string. A source without
    terms, or all of them where no term is kept, has its pairs with value 0 or the distance of its absent terms. An
    empty table gives no rows. Repeated rows count as often as they are there; other columns are not read.
    """
    frequencies = cut_lineage(term_frequencies(docs, least, entries, text_bytes))
    stats = source_stats(docs, frequencies)
    inside = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c).alias("in_lang")
    spread = frequencies.select("lang", "term", inside, F.inline(F.arrays_zip("sources", "counts")))
    spread = spread.toDF("lang", "term", "in_lang", "source", "count")
    shares = cut_lineage(
        spread.join(stats, ["lang", "source"]).select(
            "lang",
            "source",
            "gid",
            "block",
            "term",
            share("count", f"n + {PLUS} * v").alias("p"),
            share("in_lang", f"n_lang + {PLUS} * v").alias("q"),
        )
    )
    rising = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    terms = top_k(rising, ["lang", "source"], order, top, "rank").select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank"
    )
    deltas = cut_lineage(_pair_corrections(shares, stats))
    others = stats.select("lang", F.col("source").alias("item"), F.col("gid").alias("other"), F.col("p0").alias("q0"))
    absent = F.coalesce(F.col("v") * F.abs(F.col("p0") - F.col("q0")), F.lit(0))
    pairs = (
        stats.join(others, "lang")
        .where("gid <> other")
        .join(deltas, ["gid", "other"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", (absent + F.coalesce("delta", F.lit(0))).alias("value"))
    )
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return terms.unionByName(ranked)
