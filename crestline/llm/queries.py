"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crestline.llm.spot_signatures import ANCHORS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@registered("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@registered("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.token_files import token_round_trip

    return token_round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


PHRASES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
    FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS words
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT DISTINCT doc_id, item_id, i, k FROM places JOIN windows USING (k, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY 1),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)"""


@registered("op3_decontamination", PHRASES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.phrase_index import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from crestline.llm.secret_tags import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@registered("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from crestline.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = lambda c: F.crc32(F.col(c).cast("string")) % 4 == 2
    machine = toxicity.learn(docs, labels.where(~held("doc_id")))
    return toxicity.score(docs, machine).select("doc_id", F.coalesce(held("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


@registered("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from crestline.llm import language_id

    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    machines = language_id.learn(docs.where(~held))
    return language_id.predict(docs, machines).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.93),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN links ON a = r),
least_ AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN degree USING (vec_id) LEFT JOIN least_ USING (vec_id)"""


@registered("op2_near_vectors", VECTORS_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.vector_links import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@registered("op4_order_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.order_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@registered("op1_repeated_spans")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.repeated_spans import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


@registered("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.retrieval_packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


RANKED_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
totals AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS all_terms FROM d WHERE len(w) > 0),
times AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM times, totals GROUP BY term),
worth AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // all_terms))) AS s FROM times JOIN weights USING (term), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM b JOIN worth USING (term) GROUP BY 1, 2 HAVING sum(s) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY rank <= 50"""


@registered("op11_ball_search", RANKED_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.ball_search import ranked_documents

    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
    other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""


@registered("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from crestline.llm.hard_negatives import mine_negatives

    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors.withColumn("label", moved), F.col("id") % 100 == 0)


SPOTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next_t FROM documents),
n AS (SELECT *, length(t) AS n FROM d),
e AS (SELECT *, substring(t, 1, n - n // 4) || substring(next_t, 1, n // 4) AS edited FROM n),
texts AS (SELECT doc_id, 's' AS kind, t FROM e UNION ALL SELECT doc_id, 'e', edited FROM e UNION ALL SELECT doc_id, 'n', next_t FROM e),
split AS (SELECT doc_id, kind, [x FOR x IN string_split_regex(lower(t), '[^\p{L}\p{N}]+') IF x <> ''] AS ws FROM texts),
placed AS (SELECT doc_id, kind, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, unnest(list_prepend('', ws)[: len(ws)]) AS before FROM split),
content AS (SELECT *, coalesce(lead(w) OVER (PARTITION BY doc_id, kind ORDER BY i), '') AS w1 FROM placed WHERE w NOT IN (ANCHORS)),
spots AS (SELECT DISTINCT doc_id, kind, substr(md5(before || '|' || w || '|' || w1), 1, 15) AS s FROM content WHERE before = '' OR before IN (ANCHORS)),
sets AS (SELECT doc_id, coalesce(list(s ORDER BY s) FILTER (kind = 's'), []) AS s, coalesce(list(s ORDER BY s) FILTER (kind = 'e'), []) AS e, coalesce(list(s ORDER BY s) FILTER (kind = 'n'), []) AS x FROM spots GROUP BY 1),
full_ AS (SELECT e.doc_id, n, edited, coalesce(s, []) AS s, coalesce(sets.e, []) AS e, coalesce(x, []) AS x FROM e LEFT JOIN sets USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s, '') AS fingerprint, array_to_string(e, '') AS edited_fingerprint,
CASE WHEN len(s) + len(e) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(s, e))::DOUBLE / (len(s) + len(e) - len(list_intersect(s, e))) END AS near_edited,
CASE WHEN len(s) + len(x) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(s, x))::DOUBLE / (len(s) + len(x) - len(list_intersect(s, x))) END AS near_next
FROM full_""".replace("ANCHORS", ", ".join(f"'{a}'" for a in ANCHORS))


@registered("op12_spot_signatures", SPOTS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.spot_signatures import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))
