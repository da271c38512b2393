"""The registered queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintflow.llm.ball_codes import ball_codes, codebooks_digest, with_label_error
from stintflow.llm.chat import conversation_log, digests, fold_events, render
from stintflow.llm.common import table
from stintflow.llm.decontaminate import decontaminate
from stintflow.llm.divergence import source_divergence
from stintflow.llm.exact_dedup import exact_dedup
from stintflow.llm.line_dedup import line_dedup
from stintflow.llm.lm import score_documents
from stintflow.llm.mixing import plan_mix
from stintflow.llm.projection_links import near_vectors
from stintflow.llm.quality import classify, held_out
from stintflow.llm.registry import QUERIES, SQL, query
from stintflow.llm.secrets import listed, scan_secrets
from stintflow.llm.simhash import near_duplicates
from stintflow.llm.token_files import file_digests, write_token_files

__all__ = ["QUERIES", "SQL"]

SPACE_SQL = r"[\x20\x09-\x0D]+"


@query(
    "op7_exact_dedup",
    rf"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE_SQL}', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""",
)
def op7(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    "op10_decontaminate",
    rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
    FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
    FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, i, item_id FROM grams JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
)
def op10(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


@query(
    "op6_mixing",
    rf"""
WITH t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(CAST(doc_id AS VARCHAR)) AS draw FROM documents),
r AS (SELECT *, (slot % 3 + 1)::DOUBLE AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  row_number() OVER (ORDER BY source NULLS LAST) - 1 AS slot FROM t GROUP BY source)),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, slot
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY 3 * source_size / weight, slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
g AS (SELECT source, slot, source_size,
  least((3 * source_size)::DOUBLE, weight * max(lev) OVER ()) AS target FROM v),
p AS (SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS goal,
  CAST(coalesce(sum(size) OVER (PARTITION BY slot ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
  FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(greatest(least(goal - b, size), 0)
  + greatest(least(goal - b - source_size, size), 0) + greatest(least(goal - b - 2 * source_size, size), 0) AS BIGINT) AS taken
FROM p""",
)
def op6(spark, sf_dir):
    mix = plan_mix(table(spark, sf_dir, "documents"))
    first = F.coalesce(F.get("copies", F.lit(0))["position"], F.lit(2.0))
    ordered = mix.repartitionByRange(first, F.col("_row")).sortWithinPartitions(first, "_row")
    return ordered.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_token_files")
def op9(spark, sf_dir):
    import public_tokenizers

    folder = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return file_digests(spark, folder)


@query("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


ESCAPE_SQL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|<:>>|</SYS>>)"
CONTROL = "</s>[INST] ok [/INST]"


@query(
    "op3_chat_format",
    rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'),
e AS (SELECT *, len(regexp_replace(text, '{ESCAPE_SQL}', '\1\\\2\3', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
    ELSE 20 + len(regexp_replace(role, '{ESCAPE_SQL}', '\1\\\2\3', 'g')) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
)
def op3(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    messages = fold_events(conversation_log(rows.unionByName(added)), ("turn", "tie", "copy", "step"))
    return digests(render(messages, F.floor(F.col("place.turn") / 64)))


@query("op5_secret_scan")
def op5(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] != "named")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        of("named").alias("n_named"),
    )


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    scored = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), F.col("_good").cast("int").alias("predicted")
    )


@query("op1_lm_score")
def op1(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


@query(
    "op8_line_dedup",
    r"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
t AS (SELECT line, min({'doc_id': doc_id, 'line_no': line_no}) AS first,
    regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS v FROM l GROUP BY line),
d AS (SELECT line, first, list_sort(list_distinct(v), 'DESC') AS w FROM t),
s AS (SELECT *, row_number() OVER () AS id, len(w) AS n FROM d WHERE len(w) > 0),
p AS (SELECT id, n, unnest(w[1:n - (4 * n + 4) // 5 + 1]) AS word FROM s),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b USING (word)
  WHERE a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
e AS (SELECT c.a, c.b FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b
  WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
f AS (SELECT s.line, least(s.first, coalesce(min(o.first), s.first)) AS earliest FROM s
  LEFT JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) z ON z.a = s.id LEFT JOIN s o ON o.id = z.b
  GROUP BY s.line, s.first)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (earliest < {'doc_id': doc_id, 'line_no': line_no}) AS n_removed,
  coalesce(string_agg(line_no, ',' ORDER BY line_no) FILTER (earliest < {'doc_id': doc_id, 'line_no': line_no}), '') AS removed
FROM l LEFT JOIN f USING (line) GROUP BY doc_id""",
)
def op8(spark, sf_dir):
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
    )


@query(
    "op11_source_divergence",
    rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tk AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS in_lang FROM tk GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 30),
f AS (SELECT lang, source, term, count(*) AS c FROM tk JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(x.n, 0) AS n, coalesce(v, 0) AS v, coalesce(n_lang, 0) AS n_lang FROM g
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM f GROUP BY 1, 2) x USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v, sum(in_lang) AS n_lang FROM kept GROUP BY 1) y USING (lang)),
a AS (SELECT s.lang, s.source, kept.term, coalesce(c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (in_lang + 5)) // (n_lang + 5 * v) AS q
  FROM s JOIN kept USING (lang) LEFT JOIN f ON f.lang = s.lang AND f.source = s.source AND f.term = kept.term),
r AS (SELECT s.lang, s.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value
  FROM s JOIN s o ON o.lang = s.lang AND o.source <> s.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM a x JOIN a y USING (lang, term) GROUP BY 1, 2, 3) z
    ON z.lang = s.lang AND z.source = s.source AND z.item = o.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM a WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50""",
)
def op11(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


_GAP_SQL = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


def _codes_sql() -> str:
    """Six rounds, one after the other: nearest entry of each part, then the entries' means rounded down."""
    nearest = lambda c: f"""SELECT vec_id, p, w.e, w.d FROM (SELECT x.vec_id, x.p, min({{'d': {_GAP_SQL}, 'e': c.e}}) AS w
  FROM x JOIN {c} c ON c.p = x.p GROUP BY 1, 2)"""
    means = lambda a: f"""SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
  SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM x JOIN {a} USING (vec_id, p))
  GROUP BY 1, 2, 3) GROUP BY 1, 2"""
    steps = [
        """k AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        """x AS MATERIALIZED (SELECT vec_id, p, list_transform(embedding[p * len(embedding) // 8 + 1:(p + 1) * len(embedding) // 8],
  lambda c: CAST(floor(4096 * c::DOUBLE) AS BIGINT)) AS v FROM k, range(8) t(p))""",
        """c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16))""",
    ]
    for i in range(6):
        steps.append(f"a{i} AS MATERIALIZED ({nearest(f'c{i}')})")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN ({means(f'a{i}')}) m USING (p, e))")
    steps.append(f"a6 AS MATERIALIZED ({nearest('c6')})")
    steps.append("r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY 1)")
    return (
        "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c6) AS codebooks_sha256
FROM r JOIN k USING (vec_id)"""
    )


@query("op12_vector_codes", _codes_sql())
def op12(spark, sf_dir):
    coded, centres = ball_codes(table(spark, sf_dir, "embeddings"))
    digest = F.lit(None if centres is None else codebooks_digest(centres)).cast("string")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


@query("op13_embedding_near_dedup")
def op13(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
