"""The operators over their whole tables, as the registered queries, and the SQL that some are held against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import chat, langid, lmscore, media, mixing, neardup, negatives, packing, pii, quality, repair, spm, topk
from voxloom.llm.common import remainder, scratch_dir, written

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(64 * x.cast("double"))).alias("v"))
    rows = written(rows)
    found = topk.search(rows, rows.filter(F.col("vec_id") % 20 == 0), "vec_id", "v", k=20)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    model = langid.train(docs.filter(~F.col("held_out")))
    found = langid.predict(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixture(docs, repeats=1.5).select("doc_id", "source", "mix_tokens", "mix_copy", "mix_place", "mix_step", "mix_weight")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")  # noqa: E731
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined("pii_base"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    docs = docs.withColumn("learn", ~F.col("held_out"))
    scored = lmscore.score(docs, "learn", VOCABULARY)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("lm_score").alias("score"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded_digests(docs)


def encoded_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts, the ids' digest, the path's score, and whether decoding gives the text back."""
    coded = spm.encode(docs, VOCABULARY, decoded="decoded")
    return coded.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.col("piece_score").alias("score"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    media.store(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    found = media.read(spark, path).withColumnRenamed("key", "doc_id")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = neardup.near_duplicates(docs, words=3, threshold=85)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    nodes = written(chat.linear_nodes(rows.unionByName(extra)))
    formatted = chat.format_paths(nodes)
    loss = chat.under_loss(F.col("formatted"), F.col("loss_spans"))
    line = F.array_join(F.transform(chat.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        F.col("tree_id").alias("conv_id"),
        F.size(chat.parse(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.filter(F.col("embedding").isNotNull() & finite).select("vec_id", moved.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))
    return negatives.mine(rows, F.col("id") % 50 == 0)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))
    return fixed.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), WORDS)
    return pieces.select("doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_exact_topk, op2_language_id, op3_mixing, op4_pii, op5_quality, op6_lm_scoring, op7_sentencepiece, op8_media, op9_near_duplicates, op10_chat, op11_hard_negatives, op12_repair, op13_packing, pipeline)
    return {f.__name__: f for f in own}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND vec_id IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS t
  FROM d
), x AS (SELECT doc_id, unnest(t) AS g, len(t) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2
), e AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
c AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT c.id, e.b FROM c JOIN e ON c.r = e.a),
m AS (SELECT id, min(r) AS component_id FROM c GROUP BY id)
SELECT s.doc_id, CAST(len(s.t) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN m ON s.doc_id = m.id
"""

OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) AS text_len,
    length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS role_len
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + role_len + 2 + text_len + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND vec_id IS NOT NULL AND label IS NOT NULL
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(CAST(a.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 3
"""


def _edit(candidate: str, letters: str, cost: int | str) -> str:
    """A candidate of the fold as text: nine digits of cost, then the edits; so the least text is the best."""
    return f"(lpad(CAST(CAST(left({candidate}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({candidate}, 10) || '{letters}')"


def _keep(candidate: str, role: str, edit: str | None) -> str:
    more = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    kept = f"CASE WHEN coalesce(fault, '') NOT IN ('blank', 'duplicate') AND left(role, 1) = '{role}' THEN {_edit(candidate, 'K', more)} END"
    other = f", CASE WHEN coalesce(fault, '') NOT IN ('blank', 'duplicate') THEN {_edit(candidate, edit, '3 + ' + more)} END" if edit else ""
    return f"least({kept}{other})" if other else kept


CLOSED = f"""n, s, least(u, {_edit("n", "I", 3)}, {_edit("s", "I", 3)}, {_edit("a", "I", 3)}) AS u,
  least(a, {_edit("u", "J", 3)}, {_edit("n", "IJ", 6)}, {_edit("s", "IJ", 6)}) AS a"""

OP12_SQL = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(flatten(list_transform(range(1, length(key) + 1), lambda i: [CAST(ord(substr(key, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295), 4294967295) % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0
), f AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS place,
    CASE WHEN lag(role) OVER w IS NOT NULL AND left(lag(role) OVER w, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal,
    CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
      WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM (SELECT *, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last FROM d)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), fold AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS place, '000000000' AS n, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a
  FROM conversations
  UNION ALL
  SELECT c.conv_id, f.place, {_edit("n", "D", 4)}, least({_edit("s", "D", 4)}, {_keep("n", "s", None)}),
    least({_edit("u", "D", 4)}, {_keep("least(n, s, a)", "u", "R")}), least({_edit("a", "D", 4)}, {_keep("u", "a", "S")})
  FROM (SELECT conv_id, place, {CLOSED} FROM fold) c JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.place = c.place + 1
), best AS (
  SELECT conv_id, least(n, a) AS best FROM (SELECT conv_id, place, {CLOSED} FROM fold)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1
), turns AS (
  SELECT conv_id, list(role ORDER BY place) AS roles, list(text ORDER BY place) AS texts,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, sum(illegal) AS illegal
  FROM f GROUP BY conv_id
), e AS (
  SELECT b.conv_id, t.*, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS edits,
    list_transform(range(1, len(t.roles) + 1), lambda i: regexp_extract_all(substr(best, 10), '[IJ]*[DKRS]')[i]) AS steps
  FROM best b LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, cost, translate(edits, 'JS', 'IR') AS audit,
  sha256(regexp_replace(
    coalesce(array_to_string(list_transform(range(1, len(roles) + 1), lambda i:
      replace(replace(regexp_extract(steps[i], '^[IJ]*'), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10))
      || CASE right(steps[i], 1) WHEN 'D' THEN '' WHEN 'K' THEN roles[i] || ':' || texts[i] || chr(10) WHEN 'R' THEN 'user:' || texts[i] || chr(10)
        ELSE 'assistant:' || texts[i] || chr(10) END), ''), '')
    || replace(replace(regexp_extract(edits, '[IJ]*$'), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)), '
\z', '')) AS repaired_sha256
FROM e
"""


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express over whole tables; the others are tested against brute force, round trips or
    held-out accuracy."""
    return {"op1_exact_topk": OP1_SQL, "op9_near_duplicates": OP9_SQL, "op10_chat": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_repair": OP12_SQL}
