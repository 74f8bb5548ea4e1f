"""The registered queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat_template, exact_dedup, fill_middle, importance, minhash, mixing, packing, quality, sentencepiece_codec, sharding, suffix_dedup, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    more = more.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    return chat_template.read_back(chat_template.format_chats(rows.unionByName(more)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.RepeatedPassages(table(spark, sf_dir, "documents")).result()


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("locator")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("at")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), PIECE_BPE)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transform(table(spark, sf_dir, "documents"))
    restored = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_chat_formatting, op3_suffix_dedup, op4_exact_dedup, op5_packing, op6_nearest_neighbours, op7_sharding,
        op8_near_dedup, op9_sentencepiece, op10_toxicity, op11_importance, op12_mixing, op13_fill_middle,
    )
}

ORACLE_SQL = {
    "op2_chat_formatting": r"""
        WITH c AS (
          SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        t AS (
          SELECT conv_id, role, text, turn,
            length(replace(replace(replace(text, '\', chr(1)), '###', chr(1) || 'h'), '</turn>', chr(1) || 't')) + len(text) - length(replace(text, '\', '')) AS escaped
          FROM c)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(4 + length(role) + CASE WHEN role IN ('system', 'user', 'assistant') THEN 0 ELSE 1 END + 2 + escaped + 8) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op8_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (
          SELECT DISTINCT doc_id, shingle FROM (
            SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
              ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
          JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
        m AS (SELECT a, min(b) AS low FROM c GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id,
          d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id""",
    "op4_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        k AS (
          SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
            first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
    "op11_importance": r"""
        WITH f AS (
          SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
          FROM (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
        h AS (SELECT word, hex(encode(word)) AS bytes FROM (SELECT DISTINCT word FROM f)),
        b AS (
          SELECT word, xor(list_reduce(list_transform(range(0, len(bytes) // 2), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT)),
            lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, x)), 4294967295), 4294967295) % 10000 AS bucket FROM h),
        p AS (SELECT side, id, bucket, count(*) AS n FROM f JOIN b USING (word) GROUP BY ALL),
        t AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM p GROUP BY bucket),
        g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM t) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM t),
        w AS (SELECT id, sum(n) AS n, sum(n * gain) AS weight FROM p JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
        r AS (
          SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
            CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
          FROM documents LEFT JOIN w ON id = doc_id),
        o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20)
        SELECT r.*, CASE WHEN rank <= 10 * (SELECT count(*) FROM o) // 100 THEN rank END AS rank FROM r LEFT JOIN o USING (doc_id)""",
    "op12_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
            CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key FROM documents),
        a AS (SELECT CAST(sum(size) AS BIGINT) AS words, greatest(1, least(64, CAST(sum(size) AS BIGINT) // 1024)) AS block FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
        w AS (SELECT *, place % 3 + 1 AS weight FROM s),
        o AS (
          SELECT *, (SELECT words FROM a) - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
            sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, row_number() OVER (ORDER BY source_size / weight, place) AS turn FROM w),
        l AS (SELECT CAST(rest AS DOUBLE) AS rest, CAST(weights AS DOUBLE) AS weights FROM o WHERE 3 * source_size >= weight * CAST(rest AS DOUBLE) / CAST(weights AS DOUBLE) ORDER BY turn LIMIT 1),
        t AS (SELECT source, source_size, place, least(weight * rest / weights, CAST(3 * source_size AS DOUBLE)) AS target FROM w CROSS JOIN l),
        q AS (SELECT source, place, target / (seat - 0.5) AS quotient FROM (SELECT *, unnest(range(1, CAST(target / (SELECT block FROM a) AS BIGINT) + 100)) AS seat FROM t WHERE target > 0)),
        n AS (SELECT source, count(*) AS given FROM (SELECT source FROM q ORDER BY quotient DESC, place LIMIT (SELECT (2 * words + block) // (2 * block) FROM a)) GROUP BY source),
        e AS (SELECT t.*, least(coalesce(given, 0), 3 * source_size // block) * block AS quota FROM t CROSS JOIN a LEFT JOIN n ON n.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d)
        SELECT doc_id, size, source_size, target,
          greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - start - source_size)) + greatest(0, least(size, quota - start - 2 * source_size)) AS taken
        FROM p JOIN e ON e.source IS NOT DISTINCT FROM p.source""",
    "op13_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        r AS (
          SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
            CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
        c AS (
          SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
            ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
          sha256(text) AS restored_sha256 FROM c""",
}
