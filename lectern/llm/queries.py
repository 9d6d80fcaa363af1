"""The queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import chat, decontaminate, language_id, minhash, pii, quality_classifier, quality_rules, sentencepiece, url_filter, warc
from lectern.llm.sampling import held_out
from lectern.scratch import Scratch

KEEP_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(documents, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """A stand-in for a block list: an eighth of the hosts of three labels or more, by their MD5."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("key")).distinct()
    return hosts.where(F.substring(F.md5(F.encode("key", "UTF-8")), 1, 1).isin("0", "1") & F.col("key").rlike(r"\..*\."))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, listed_hosts(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(documents, pii.train(documents))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Scratch(spark, "warc").keep(warc.write_archives(table(spark, sf_dir, "pages")), "archives", compression="none")
    read = warc.read_archives(archives, payloads=False).where("kind = 'record'")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.train(documents)
    found = language_id.predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = sentencepiece.encoded(documents, sentencepiece.load_vocabulary(), keep_text=False)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    forests = quality_rules.train(documents, table(spark, sf_dir, "labels"))
    return quality_rules.judge(documents, forests).select("doc_id", *quality_rules.BASE, "base_failed", "kept", "anomaly")


def op10_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_segments(chat.swapped_replies(table(spark, sf_dir, "conversations")))


def weighted_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate operator on multisets: each run of words weighs as often as it occurs."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Settings(weights="count"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_url_filter,
        op3_pii,
        op4_benchmark_decontamination,
        op5_warc,
        op6_language_id,
        op7_sentencepiece,
        op8_minhash_near_dedup,
        op9_quality_rules,
        op10_chat_preference,
        weighted_near_dedup,
    )
}

SHINGLES_SQL = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)
"""

ORACLES: dict[str, str] = {
    "op2_url_filter": r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), q AS (
  SELECT *,
         CASE WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
         substr(md5(host), 1, 1) IN ('0', '1') AND regexp_matches(host, '\..*\.') AS listed
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       listed
FROM q
""",
    # for items of five words or more
    "op4_benchmark_decontamination": SHINGLES_SQL
    + r"""
, v AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM v),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM x JOIN q USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM h JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_item
""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
l AS (SELECT h, payload_bytes, max(page_id) AS last FROM k GROUP BY ALL)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM k JOIN l USING (h, payload_bytes)
""",
    "op8_minhash_near_dedup": SHINGLES_SQL.replace("WITH w", "WITH RECURSIVE w")
    + """
, n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 5 * c >= 4 * (m.n + k.n - c)),
link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, r.root FROM r JOIN link ON link.a = r.doc_id WHERE r.root < link.b)
SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id
""",
    "weighted_near_dedup": SHINGLES_SQL.replace("WITH w", "WITH RECURSIVE w").replace("SELECT DISTINCT doc_id, unnest", "SELECT doc_id, unnest")
    + """
, m AS (SELECT doc_id, s, count(*) AS k FROM x GROUP BY ALL),
n AS (SELECT doc_id, sum(k) AS n FROM m GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.k, b.k)) AS c FROM m a JOIN m b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 5 * c >= 4 * (m.n + k.n - c)),
link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, r.root FROM r JOIN link ON link.a = r.doc_id WHERE r.root < link.b)
SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id
""",
    "op10_chat_preference": """
WITH t AS (
  SELECT DISTINCT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), last AS (
  SELECT pair_id, turn, text FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC) = 1
), swapped AS (
  SELECT a.pair_id, a.turn, b.text FROM last a JOIN last b ON b.pair_id = xor(a.pair_id, 1)
), sides AS (
  SELECT pair_id, 'chosen' AS side, turn, role, text FROM t
  UNION SELECT pair_id, 'rejected', turn, role, text FROM t WHERE NOT (role = 'assistant' AND (pair_id, turn) IN (SELECT (pair_id, turn) FROM swapped))
  UNION SELECT pair_id, 'rejected', turn, 'assistant', text FROM swapped
), differ AS (
  SELECT pair_id, min(turn) AS first FROM (SELECT pair_id, turn, role, text FROM sides GROUP BY ALL HAVING count(DISTINCT side) = 1) GROUP BY pair_id
), parts AS (
  SELECT DISTINCT pair_id, CASE WHEN coalesce(turn < first, true) THEN 'prompt' ELSE side END AS part, turn, role, text FROM sides LEFT JOIN differ USING (pair_id)
), shown AS (
  SELECT *, '<|im_start|>' || replace(role, '<|', '< |') || chr(10) AS header, replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS body,
         part <> 'prompt' AND role = 'assistant' AS learned
  FROM parts
)
SELECT pair_id, part, turn, role, CASE WHEN learned THEN header ELSE header || body END AS masked, CASE WHEN learned THEN body ELSE '' END AS target
FROM shown
""",
}
