"""The queries of the corpus operators and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import cap_filters, label_sharding, language_id, mixing, ngram_jaccard, orc_tokens, substring_dedup, tier_packing, tiff_media, url_cascade
from rankloom.llm.common import drop_path, shared_path

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.linked_documents(table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op3_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("same")
    )
    out = label_sharding.shard_rows(docs, "doc_id", "same", 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op5_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_media.text_round_trip(table(spark, sf_dir, "documents"))


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    orc_tokens.write_tokens(table(spark, sf_dir, "documents"), path, word_tokenizer())
    out = orc_tokens.token_index(spark, path)
    drop_path(spark, path)
    return out


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.train(docs), ["doc_id"])
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "slot")


def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_gear_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), r(doc_id, c) AS (
  SELECT DISTINCT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

OP9_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), hits AS (
  SELECT page_id, p.host, p.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
  GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, hits.rule, coalesce(hits.verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT DISTINCT * FROM hits) hits ON p.page_id IS NOT DISTINCT FROM hits.page_id AND p.host = hits.host AND p.path = hits.path
"""

# Targets by the contract's own words: deal what is left by weight, cut at twice the source, deal the excess again,
# until none is above. Taken: of the words 0 .. target - 1 along the source's stream, repeated, those of the document.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source
), c AS (SELECT *, [3, 1, 2][(idx % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS most FROM s
), r(turn, idx, w, most, target, full_) AS (
  SELECT 0, idx, w, most, 0.0::DOUBLE, false FROM c
  UNION ALL
  SELECT turn + 1, idx, w, most, CASE WHEN full_ OR share * w >= most THEN most ELSE share * w END, full_ OR share * w >= most
  FROM (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - sum(CASE WHEN full_ THEN most ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () AS share
        FROM r WHERE turn < (SELECT count(*) + 1 FROM s))
), t AS (
  SELECT s.*, round(r.target, 6) AS target, floor(round(r.target, 6) + 0.5)::BIGINT AS words FROM r JOIN s USING (idx) WHERE turn = (SELECT max(turn) FROM r)
), b AS (SELECT *, greatest(1, least(greatest(64, ceil(words / 4096)), floor(words / 64)))::BIGINT AS block FROM t
), k AS (SELECT *, ceil(words / block)::BIGINT AS slots FROM b
), sp AS (
  SELECT idx, slots, floor((sum(slots) OVER (ORDER BY idx))::HUGEINT * 4294967296 // (sum(slots) OVER ())::HUGEINT)::BIGINT AS hi, (sum(slots) OVER ())::BIGINT AS n FROM k WHERE slots > 0
), lohi AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY idx), 0) AS lo FROM sp
), points AS (SELECT g AS slot, (g::BIGINT * 2654435769) % 4294967296 AS point FROM (SELECT unnest(generate_series(0, (SELECT max(n) - 1 FROM sp))) AS g)
), dealt AS (SELECT idx, slots, slot, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS rank FROM points JOIN lohi ON point >= lo AND point < hi
), got AS (SELECT idx, count(*) AS got FROM dealt GROUP BY idx
), sched AS (
  SELECT idx, rank, slot FROM dealt WHERE rank < slots
  UNION ALL
  SELECT idx, g.rank, g.rank + n FROM (SELECT idx, n, unnest(generate_series(coalesce(got, 0), slots - 1)) AS rank FROM sp LEFT JOIN got USING (idx)) g
), placed AS (
  SELECT d.*, k.idx, source_size, target, words, block, coalesce(sum(size) OVER (PARTITION BY k.idx ORDER BY substr(h, 1, 12), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
), took AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (SELECT coalesce(sum(greatest(0, least(words, i * source_size + start + size) - (i * source_size + start))), 0) FROM range(0, 2) x(i)) END::BIGINT AS taken FROM placed
)
SELECT doc_id, size, source_size, target, taken, coalesce(slot, -1)::BIGINT AS slot FROM took LEFT JOIN sched ON sched.idx = took.idx AND sched.rank = took.start // took.block AND taken > 0
"""

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_cap_filters": op2_cap_filters,
    "op3_label_sharding": op3_label_sharding,
    "op4_tier_packing": op4_tier_packing,
    "op5_tiff_media": op5_tiff_media,
    "op6_orc_tokens": op6_orc_tokens,
    "op7_language_id": op7_language_id,
    "op8_source_schedule": op8_source_schedule,
    "op9_url_cascade": op9_url_cascade,
    "op10_gear_dedup": op10_gear_dedup,
}
SQL = {"op1_ngram_jaccard": OP1_SQL, "op8_source_schedule": OP8_SQL, "op9_url_cascade": OP9_SQL}
