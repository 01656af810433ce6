"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, jaccard_join, language, packing, passages, quality, sharding, toxicity, warc
from .storage import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    read = chat.read_windows(chat.format_windows(turns.unionByName(more), budget=1024, history_turns=2, history_budget=256))
    loss = F.array_join("targets", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(_table(spark, sf_dir, "documents"))


def _fold(column: str, parts: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(_fold("doc_id", 3) != 1)
    model = toxicity.fit(docs.withColumnRenamed("doc_id", "id"), labels.withColumnRenamed("doc_id", "id"))
    score = toxicity.score(docs, model)
    return score.select("doc_id", (_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), gram=5, window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), limit=2048, end_id=0)


def _language_model(docs: DataFrame) -> language.Model:
    return language.fit(docs.where(_fold("doc_id", 4) != 2).select("text", "lang"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, _language_model(docs))
    return found.select("doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc.write_bundles(_table(spark, sf_dir, "pages"), Scratch(spark), revisit_bytes=1000)
    return warc.read_records(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_substring_dedup, op3_toxicity, op4_winnowing, op5_quality_rules, op6_best_fit_packing, op7_language_id, op8_warc, op9_ngram_jaccard_join, op10_sharding)
}

_OP4_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1_COST = r"CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^ \t\n\r\p{L}\p{N}]')) + 4 AS BIGINT)"


def _op1_escaped(text: str) -> str:
    text = f"replace({text}, '\\', '\\e')"
    for control, short in (("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("[INST]", "\\bINST]"), ("[/INST]", "\\b/INST]")):
        text = f"replace({text}, '{control}', '{short}')"
    return text


ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, {_OP1_COST} AS cost, row_number() OVER w AS pos FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
        length({_op1_escaped("role")}) + length({_op1_escaped("text")}) + 21 AS chars,
        max(CASE WHEN pos = 1 AND role = 'system' THEN cost END) OVER (PARTITION BY conv_id) AS sys FROM t),
r AS (SELECT conv_id, pos, pos AS start, prefix - cost AS base FROM p WHERE pos = CASE WHEN sys IS NULL THEN 1 ELSE 2 END
  UNION ALL
  SELECT p.conv_id, p.pos, CASE WHEN p.prefix - r.base > 768 - coalesce(sys, 0) THEN p.pos ELSE r.start END,
         CASE WHEN p.prefix - r.base > 768 - coalesce(sys, 0) THEN p.prefix - p.cost ELSE r.base END
  FROM r JOIN p ON p.conv_id = r.conv_id AND p.pos = r.pos + 1),
win AS (SELECT DISTINCT conv_id, start FROM r),
again AS (SELECT win.conv_id, sum(p.chars) AS chars FROM win JOIN p ON p.conv_id = win.conv_id AND p.pos < win.start AND p.pos >= win.start - 2
            AND p.pos >= CASE WHEN p.sys IS NULL THEN 1 ELSE 2 END
          JOIN p q ON q.conv_id = win.conv_id AND q.pos = win.start - 1 WHERE q.prefix - p.prefix + p.cost <= 256 GROUP BY 1),
heads AS (SELECT win.conv_id, sum(p.chars) AS chars FROM win JOIN p ON p.conv_id = win.conv_id AND p.pos = 1 AND p.sys IS NOT NULL
          WHERE win.start > 2 GROUP BY 1),
loss AS (SELECT conv_id, string_agg(text, '' ORDER BY pos) AS said FROM p WHERE role = 'assistant' GROUP BY 1),
base AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, sum(chars) AS chars FROM p GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, CAST(length(coalesce(said, '')) AS BIGINT) AS loss_chars, sha256(coalesce(said, '')) AS loss_sha256,
       CAST(base.chars + coalesce(again.chars, 0) + coalesce(heads.chars, 0) AS BIGINT) AS formatted_chars
FROM base LEFT JOIN loss USING (conv_id) LEFT JOIN again USING (conv_id) LEFT JOIN heads USING (conv_id)""",
    "op4_winnowing": f"""
WITH d AS (SELECT doc_id, {_OP4_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_OP4_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, s)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op5_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, host, line, list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw FROM l),
ln AS (SELECT doc_id, host, line, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM lw WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY 1),
often AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS n FROM ln GROUP BY 1, 2)
          JOIN (SELECT host, count(*) AS docs FROM d GROUP BY 1) USING (host) WHERE n > 20 AND n > 0.01 * docs),
gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS removed_words FROM ln JOIN often USING (host, norm) GROUP BY 1),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY 1),
st AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
       FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM st)
SELECT *, NOT base_failed AND n_words - removed_words >= 50 AND n_words - removed_words >= 0.3 * n_words AS kept FROM f""",
    "op8_warc": """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
g AS (SELECT digest, max(page_id) AS last FROM p GROUP BY digest)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p JOIN g USING (digest)""",
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) r USING (doc_id)""",
}
