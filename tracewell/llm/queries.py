"""The thin queries of the corpus operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, licenses, media, packing, repair, secrets, sharding, shingles, spelling, suffixes, toxicity, vectors
from .common import fold, read

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.near_texts(read(spark, sf_dir, "documents"), percent=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    network = toxicity.train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs, network).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_windows")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    exact = F.filter("spans", lambda s: s.exact == 1)
    starts = F.transform(exact, lambda s: s["first"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(exact).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("spans", lambda s: s.cover)), F.lit(0.0))).alias("score"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs, fold("doc_id", 4) != 2, public_tokenizers.path(PIECES))
    return language.predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    stored = media.store_texts(docs)
    figures = media.sequences(media.document_pages(docs), "doc_id").where("kind = 'media'").select("doc_id", "digest", "position", "caption")
    found = media.resolve(figures, stored)
    return found.select("doc_id", F.regexp_extract("caption", r"(\d+)$", 1).cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated(read(spark, sf_dir, "documents"), keep_text=False)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_bytes", (total("high") - total("low")).alias("n_removed"), F.size("low").cast("long").alias("n_spans"), "kept_sha256", (F.size("low") > 0).alias("cut"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return coded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(read(spark, sf_dir, "documents"), spoil=97))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    ids, found = turns.select("conv_id").distinct(), repair.repair(repair.damage(turns))
    every = ids.alias("i").join(found.alias("r"), F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    longs = [F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("i.conv_id", *longs, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("r.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_pivots": op1_pivots,
    "op2_forest": op2_forest,
    "op3_toxicity": op3_toxicity,
    "op4_pack": op4_pack,
    "op5_shard": op5_shard,
    "op6_licenses": op6_licenses,
    "op7_language": op7_language,
    "op8_media": op8_media,
    "op9_suffixes": op9_suffixes,
    "op10_bpe": op10_bpe,
    "op11_secrets": op11_secrets,
    "op12_spelling": op12_spelling,
    "op13_repair": op13_repair,
}

def _repair_sql() -> str:
    """The cheapest edits from each of four states, row by row from a conversation's end."""
    way = lambda cost, edit, line, rest: f"{{'c': {rest}.c + {cost}, 'a': '{edit}' || {rest}.a, 'l': {line} || {rest}.l}}"
    after, keeps = (2, 2, 3, 2), ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})

    def row(q: int) -> str:
        kept = " ".join(f"WHEN fault < 2 AND first = '{x}' THEN {way('fault', 'K', '[line]', f's{to}')}" for x, to in keeps[q].items())
        name = "assistant" if q == 2 else "user"
        changed = way("2 + fault", "R", f"['{name}:' || text]", f"s{after[q]}")
        return f"list_min([{way(3, 'D', '[]', f's{q}')}, CASE {kept} END, CASE WHEN fault < 2 THEN {changed} END]) AS e{q}"

    insert = lambda rest, name: way(2, "I", f"['{name}:']", rest)
    last = "{'c': 0, 'a': '', 'l': CAST([] AS VARCHAR[])}, {'c': 4, 'a': 'II', 'l': ['user:', 'assistant:']}, {'c': 2, 'a': 'I', 'l': ['assistant:']}, {'c': 0, 'a': '', 'l': CAST([] AS VARCHAR[])}"
    return f"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT row_number() OVER () AS id, dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations
), b AS MATERIALIZED (
  SELECT i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384), i) AS c FROM range(256) AS x(i)
), crc(id, rest, h) AS (
  SELECT id, hex(k), 4294967295 FROM t
  UNION ALL
  SELECT id, substr(rest, 3), xor(c, h >> 8) FROM crc JOIN b ON b.i = xor(h & 255, CAST('0x' || substr(rest, 1, 2) AS BIGINT)) WHERE rest <> ''
), d AS MATERIALIZED (
  SELECT t.g, t.turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE m WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM t JOIN (SELECT id, xor(4294967295, h) % 20 AS m FROM crc WHERE rest = '') x ON x.id = t.id
), o AS MATERIALIZED (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, lag(left(role, 1)) OVER w || left(role, 1) AS pair, left(role, 1) AS first, role || ':' || text AS line,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), r AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' OR again THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault FROM o
), best(g, i, s0, s1, s2, s3) AS (
  SELECT g, n + 1, {last} FROM r WHERE i = 1
  UNION ALL
  SELECT g, i, list_min([e0, {insert('f2', 'user')}]), list_min([e1, {insert('f2', 'user')}]), f2, f3 FROM (
    SELECT *, list_min([e2, {insert('e3', 'assistant')}]) AS f2, list_min([e3, {insert('e2', 'user')}]) AS f3 FROM (
      SELECT r.g, r.i, {', '.join(map(row, range(4)))} FROM best JOIN r ON r.g = best.g AND r.i = best.i - 1))
), sums AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE bare = '') AS blank, count(*) FILTER (WHERE bare <> '' AND again) AS duplicate, count(*) FILTER (WHERE fault = 1) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY g
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM t) c LEFT JOIN sums ON sums.g = c.g LEFT JOIN best ON best.g = c.g AND best.i = 1
"""


ORACLES: dict[str, str] = {
    "op1_pivots": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, r) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r
), comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT v.vec_id, coalesce((SELECT count(*) FROM links WHERE links.a = v.vec_id), 0) AS n_links,
       comp.component_id, comp.component_id = v.vec_id AS kept
FROM v LEFT JOIN comp ON comp.id = v.vec_id
""",
    "op2_forest": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w
), rep AS (SELECT min(doc_id) AS rep, list_sort(s) AS k FROM s WHERE len(s) > 0 GROUP BY list_sort(s)
), x AS (SELECT rep, len(k) AS n, unnest(k) AS g FROM rep
), shared AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS hits
  FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep
), links AS (SELECT a, b FROM shared WHERE 100 * hits >= 85 * (na + nb - hits)
), reach(id, r) AS (SELECT rep, rep FROM rep UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r
), comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(comp.c, s.doc_id) AS component_id, coalesce(comp.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN rep ON len(s.s) > 0 AND rep.k = list_sort(s.s) LEFT JOIN comp ON comp.id = rep.rep
""",
    "op12_spelling": r"""
WITH RECURSIVE r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY doc_id, run
), k AS MATERIALIZED (
  SELECT *, row_number() OVER () AS id, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS blob FROM r
), t AS MATERIALIZED (
  SELECT i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384), i) AS c FROM range(256) AS x(i)
), crc(id, rest, h) AS (
  SELECT id, hex(blob), 4294967295 FROM k
  UNION ALL
  SELECT id, substr(rest, 3), xor(c, h >> 8) FROM crc JOIN t ON t.i = xor(h & 255, CAST('0x' || substr(rest, 1, 2) AS BIGINT)) WHERE rest <> ''
), hashed AS MATERIALIZED (
  SELECT k.*, xor(4294967295, crc.h) AS h FROM k JOIN crc ON crc.id = k.id AND crc.rest = ''
), w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)
), near AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.p = b.p AND a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN w ON w.word = c.p || c.s
  UNION SELECT w.word, c.word FROM cuts c JOIN w ON w.word = c.p || c.s
), best AS (
  SELECT near.a AS word, count(*) AS n_near, min({'less': -w.n, 'word': near.b}) AS top FROM near JOIN w ON w.word = near.b GROUP BY near.a
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 2 * w.n THEN top.word END AS form, CASE WHEN -top.less >= 2 * w.n THEN -top.less END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word
), steps AS MATERIALIZED (
  SELECT word AS source, form AS goal FROM formed WHERE form IS NOT NULL
), way(word, target) AS (SELECT word, word FROM w UNION SELECT way.word, steps.goal FROM way JOIN steps ON steps.source = way.target)
SELECT formed.*, way.target AS root FROM formed JOIN way ON way.word = formed.word JOIN formed AS f ON f.word = way.target WHERE f.form IS NULL
""",
    "op13_repair": _repair_sql(),
}
