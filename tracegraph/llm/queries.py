"""Registered queries of the corpus operators: thin calls that derive the digest columns, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegraph.llm import decontaminate, language_id, line_dedup, mixing, pii, prefix_trie, quality_model, quality_rules, sharding, simhash, toxicity, vector_codes, warc
from tracegraph.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


MIX_SQL = r"""
WITH s AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5('42:' || doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
src AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM s GROUP BY key),
rk AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM src),
wt AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((nth - 1) % 3 + 1)::INT] AS weight FROM rk),
lv AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER b, 0) * 2)
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
       FROM wt WINDOW b AS (ORDER BY source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT key, source_size, docs, least(source_size * 2.0::DOUBLE, max(level) OVER () * weight) AS target FROM lv),
st AS (SELECT *, round(sum(target) OVER () / 16)::BIGINT AS seats, sum(target) OVER () AS total, count(*) OVER () AS n FROM tg),
sb AS (SELECT *, CASE WHEN total > 0 THEN target * seats / total ELSE 0 END AS share,
              CASE WHEN total > 0 THEN target * n / (2 * total) ELSE 0 END AS slack FROM st),
sl AS (SELECT *, greatest(0, floor(share - slack) - 1)::BIGINT AS low, (ceil(share + slack) + 1)::BIGINT AS high FROM sb),
sx AS (SELECT *, CASE WHEN total > 0 THEN seats ELSE 0 END - sum(low) OVER () AS lft FROM sl),
se AS (SELECT *, unnest(generate_series(low, high)) AS seat FROM sx),
sw AS (SELECT *, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, key, seat) <= lft AS won FROM se),
sq AS (SELECT key, any_value(source_size) AS source_size, any_value(target) AS target, any_value(docs) AS docs,
              (any_value(low) + sum(won::INT))::BIGINT AS source_quota FROM sw GROUP BY key),
p AS (SELECT s.*, source_size, target, source_quota, h % greatest(1, ceil(docs / 512.0))::BIGINT AS cell FROM s JOIN sq USING (key)),
c AS (SELECT key, cell, cell // 256 AS shard, sum(size)::BIGINT AS words, any_value(source_quota) AS source_quota FROM p GROUP BY ALL),
h1 AS (SELECT key, shard, sum(words)::BIGINT AS v, any_value(source_quota) AS seats FROM c GROUP BY ALL),
h2 AS (SELECT *, (sum(v) OVER g)::DOUBLE AS total, count(*) OVER g AS n FROM h1 WINDOW g AS (PARTITION BY key)),
h3 AS (SELECT *, CASE WHEN total > 0 THEN v * seats / total ELSE 0 END AS share, CASE WHEN total > 0 THEN v * n / (2 * total) ELSE 0 END AS slack FROM h2),
h4 AS (SELECT *, greatest(0, floor(share - slack) - 1)::BIGINT AS low, (ceil(share + slack) + 1)::BIGINT AS high FROM h3),
h5 AS (SELECT *, CASE WHEN total > 0 THEN seats ELSE 0 END - sum(low) OVER (PARTITION BY key) AS lft FROM h4),
h6 AS (SELECT *, unnest(generate_series(low, high)) AS seat FROM h5),
h7 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY v / (2 * seat + 1) DESC, shard, seat) <= lft AS won FROM h6),
hq AS (SELECT key, shard, (any_value(low) + sum(won::INT))::BIGINT AS seats FROM h7 GROUP BY ALL),
c1 AS (SELECT c.key, c.shard, cell, words AS v, hq.seats FROM c JOIN hq ON c.key = hq.key AND c.shard = hq.shard),
c2 AS (SELECT *, (sum(v) OVER g)::DOUBLE AS total, count(*) OVER g AS n FROM c1 WINDOW g AS (PARTITION BY key, shard)),
c3 AS (SELECT *, CASE WHEN total > 0 THEN v * seats / total ELSE 0 END AS share, CASE WHEN total > 0 THEN v * n / (2 * total) ELSE 0 END AS slack FROM c2),
c4 AS (SELECT *, greatest(0, floor(share - slack) - 1)::BIGINT AS low, (ceil(share + slack) + 1)::BIGINT AS high FROM c3),
c5 AS (SELECT *, CASE WHEN total > 0 THEN seats ELSE 0 END - sum(low) OVER (PARTITION BY key, shard) AS lft FROM c4),
c6 AS (SELECT *, unnest(generate_series(low, high)) AS seat FROM c5),
c7 AS (SELECT *, row_number() OVER (PARTITION BY key, shard ORDER BY v / (2 * seat + 1) DESC, cell, seat) <= lft AS won FROM c6),
c8 AS (SELECT key, cell, v AS words, ceil(v / 16.0)::BIGINT AS blocks, (any_value(low) + sum(won::INT))::BIGINT AS quota FROM c7 GROUP BY key, cell, v),
cq AS (SELECT key, cell, words, blocks, CASE WHEN blocks > 0 THEN least(quota, 2 * blocks) // blocks ELSE 0 END AS copies,
              CASE WHEN blocks > 0 THEN least(quota, 2 * blocks) % blocks ELSE 0 END AS extra,
              CASE WHEN blocks > 0 THEN ('0x' || substr(md5('42 start:' || key || ':' || cell), 1, 15))::BIGINT % blocks ELSE 0 END AS start FROM c8),
d AS (SELECT p.*, words, blocks, copies, extra, start, sum(size) OVER (PARTITION BY p.key, p.cell ORDER BY h, doc_id)::BIGINT AS t
      FROM p JOIN cq ON p.key = cq.key AND p.cell = cq.cell)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (copies * size + greatest(0, least(least(least(start + extra, blocks) * 16, words), t) - greatest(start * 16, t - size))
        + greatest(0, least(greatest(0, start + extra - blocks) * 16, t) - (t - size)))::BIGINT AS taken
FROM d"""


@query("op4_sainte_lague_mix", MIX_SQL)
def _(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_byte_prefix_shards")
def _(spark, sf_dir):
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
gc AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
rp AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM gc WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
lf AS (SELECT doc_id, l, n,
   (n > 0 AND (4 * len(regexp_extract_all(l, '[#*$%&|<>]')) > n OR 4 * len(regexp_extract_all(l, '[!?]{2}')) > n
               OR (n >= 20 AND NOT regexp_matches(l, '[.!?,;:。،।…]'))))
   OR (n BETWEEN 1 AND 10 AND (regexp_matches(l, '(^|\s)[|»›•>](\s|$)') OR regexp_matches(l, '(?i)^\W*(home|menu|log ?in|log ?out|sign ?in|sign ?up|register|next|previous|search|contact( us)?|about( us)?|back to top|share|read more|skip to content|sitemap|help|faq)\W*$')))
   OR (n BETWEEN 1 AND 30 AND regexp_matches(l, '(?i)(all rights reserved|licensed under|released under the|cookie policy|we use cookies|privacy policy|terms of (use|service)|copyright|©|enable javascript|subscribe to|click here|powered by)')) AS bad
   FROM l),
ls AS (SELECT doc_id, sum(n) FILTER (bad) AS lost, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS dup FROM lf GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, dup AS n_dup_lines, coalesce(rp.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM w JOIN ls USING (doc_id) LEFT JOIN rp USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * n_words AS kept
FROM b"""


@query("op7_line_first_rules", RULES_SQL)
def _(spark, sf_dir):
    judged = quality_rules.clean_lines(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_pii_spans")
def _(spark, sf_dir):
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    spans = F.col("pii")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS[:pii.BASE]],
                        F.sha2(said(F.filter(spans, lambda s: s["rank"] < pii.BASE)).cast("binary"), 256).alias("base_sha256"), said(spans).alias("spans"),
                        F.size(spans).cast("bigint").alias("n_spans"), *[count(k) for k in pii.KINDS[pii.BASE:]])


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


@query("op2_warc_round_trip", WARC_SQL)
def _(spark, sf_dir):
    records = warc.archive_pages(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    key = lambda c: F.regexp_extract(c, "^urn:key:(-?[0-9]+)$", 1)
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(F.col("payload_bytes"))
    number = lambda c: F.when(key(c) != "", key(c).cast("bigint"))
    return records.select(number("record_id").alias("page_id"), size.cast("bigint").alias("payload_bytes"), digest.alias("payload_digest"),
                          "record_type", number("refers_to").alias("refers_to"))


@query("op5_simhash_anchor_covering")
def _(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


INDEX_SQL = r"""
WITH b AS (SELECT item_id::VARCHAR AS id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark)),
wi AS (SELECT DISTINCT id, least(13, len(w)) AS n, list_aggregate(w[i:i + least(13, len(w)) - 1], 'string_agg', ' ') AS g
       FROM (SELECT id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
s AS (SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM wi) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, s.n, id FROM s JOIN wi ON s.g = wi.g AND s.n = wi.n),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op6_positional_index", INDEX_SQL)
def _(spark, sf_dir):
    rows = decontaminate.numbered(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    found = decontaminate.contamination(spark, rows.select("row", "doc.text"), table(spark, sf_dir, "benchmark"))
    return found.join(rows.select("row", "doc.doc_id"), "row").select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def _scored(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op1_kneser_ney_toxicity")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(toxicity.train(spark, docs, table(spark, sf_dir, "labels")).score(docs), 0.7)


@query("op3_compression_quality")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(quality_model.train(spark, docs, table(spark, sf_dir, "labels")).score(docs), 0.5)


@query("op10_patience_line_dedup")
def _(spark, sf_dir):
    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    numbers = F.array_join(F.col("removed").cast("array<string>"), ",")
    return clean.select("doc_id", "n_lines", "n_removed", "removed_words", numbers.alias("removed_lines"), "text")


def _codes_sql(rounds: int = 4) -> str:
    """Chained passes: nearest entries by exact inner products of integers held as doubles, then means rounded down."""
    ctes = [r"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
   WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
p AS MATERIALIZED (SELECT vec_id, part, list_slice(v, part * (len(v) // 4) + 1, (part + 1) * (len(v) // 4)) AS q FROM k, range(4) r(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, q AS c FROM p
       WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256))"""]
    for n in range(rounds + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (SELECT vec_id, part, any_value(q) AS q, min([d, e]) AS best FROM
   (SELECT vec_id, part, q, e::DOUBLE AS e, list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c) AS d FROM p JOIN c{n} USING (part))
   GROUP BY vec_id, part)""")
        if n < rounds:
            ctes.append(f"""m{n} AS (SELECT part, e, list(m ORDER BY i) AS c FROM (SELECT part, best[2] AS e, i, floor(sum(q[i]) / count(*)) AS m
   FROM a{n}, range(1, 4097) r(i) WHERE i <= len(q) GROUP BY ALL) GROUP BY part, e),
c{n + 1} AS MATERIALIZED (SELECT c{n}.part, c{n}.e, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} ON c{n}.part = m{n}.part AND c{n}.e = m{n}.e)""")
    return "WITH " + ",\n".join(ctes) + f""",
s AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda x: x::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY part, e)) AS h FROM c{rounds}),
r AS (SELECT vec_id, string_agg(printf('%02x', best[2]::INT), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM s) AS codebooks_sha256 FROM r JOIN k USING (vec_id)"""


@query("op13_slice_intersect_codes", _codes_sql())
def _(spark, sf_dir):
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


TRIE_SQL = r"""
WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i)
   UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
t8 AS (SELECT i, v FROM bits WHERE k = 8),
own AS (SELECT conv_id AS c, count(*) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc(c, pos, v) AS (SELECT c, 0, 4294967295::BIGINT FROM own
   UNION ALL SELECT c, pos + 1, xor(crc.v >> 8, t8.v) FROM crc JOIN t8 ON t8.i = xor(crc.v, ascii(substr(c::VARCHAR, pos + 1, 1))) & 255 WHERE pos < length(c::VARCHAR)),
h AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE pos = length(c::VARCHAR)),
t AS (SELECT conv_id AS c, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
             md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, code, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, code) - 1 AS k FROM t),
cv AS (SELECT own.c, own.c - own.c % 20 AS b, h, least(h, coalesce(o.own, 0)) AS lent FROM own JOIN h USING (c) LEFT JOIN own o ON o.c = own.c - own.c % 20),
s AS (SELECT c, k - h + lent + 1 AS d, code, w FROM n JOIN cv USING (c) WHERE k >= h
      UNION ALL SELECT cv.c, k + 1, code, w FROM cv JOIN n ON n.c = cv.b WHERE k < h),
f AS (SELECT cv.c, coalesce(codes, '') AS codes, coalesce(ws, []) AS ws FROM cv LEFT JOIN
      (SELECT c, string_agg(code, '' ORDER BY d) AS codes, list(w ORDER BY d) AS ws FROM s GROUP BY c) g USING (c)),
x AS (SELECT c, codes, ws, unnest(range(0, len(ws) + 1)) AS d FROM f),
nd AS (SELECT left(codes, 32 * d) AS key, d, min(c) AS c, count(*) AS n, max(coalesce(ws[d], 0)) AS w,
              string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ws) = d) AS e FROM x GROUP BY ALL),
kd AS (SELECT left(key, 32 * (d - 1)) AS key, count(*) AS kids FROM nd WHERE d > 0 GROUP BY ALL),
tr AS (SELECT nd.*, coalesce(kids, 0) AS kids FROM nd LEFT JOIN kd ON kd.key = nd.key),
su AS (SELECT left(key, 32 * a) AS key, sum((n - 1) * w)::BIGINT AS saved, count(*) FILTER (kids = 0) AS leaves
       FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM tr) GROUP BY ALL)
SELECT tr.c AS conv_id, tr.d::BIGINT AS depth, up.c AS parent_conv_id, tr.n::BIGINT AS n_convs, tr.kids AS n_children, leaves AS n_leaves,
       saved AS saved_tokens, sha256(coalesce(tr.e, '')) AS ends_sha256
FROM tr JOIN su USING (key) LEFT JOIN tr up ON tr.d > 0 AND up.d = tr.d - 1 AND up.key = left(tr.key, 32 * (tr.d - 1))"""


@query("op12_z_fast_trie", TRIE_SQL)
def _(spark, sf_dir):
    trie = prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query("op11_ftrl_language_id")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = language_id.train(docs).predict(docs.select("doc_id", "text"))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
