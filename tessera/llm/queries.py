"""Queries of the ten operators with production parameters, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, decontam, htmlmain, langid, linededup, lm, minhash, tokenbin, warc
from tessera.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=1.0)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classify(table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.archive(spark, table(spark, sf_dir, "documents"), VOCABULARY)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeats(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive(spark, table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vp_tree": op1_vp_tree,
    "op2_minhash": op2_minhash,
    "op3_lm_score": op3_lm_score,
    "op4_language_id": op4_language_id,
    "op5_token_archive": op5_token_archive,
    "op6_decontamination": op6_decontamination,
    "op7_bpe": op7_bpe,
    "op8_line_dedup": op8_line_dedup,
    "op9_main_text": op9_main_text,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op1_vp_tree": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_inner_product(v.x, q.x) / (sqrt(list_inner_product(v.x, v.x)) * sqrt(list_inner_product(q.x, q.x))) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op2_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(d, t) AS (SELECT x, y FROM e UNION SELECT r.d, e.y FROM r JOIN e ON e.x = r.t),
m AS (SELECT d, min(t) AS t FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.t, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(m.t, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.d = w.doc_id
""",
    # Every window that counts has three equal words in a row; a shorter item is one run.
    "op6_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT DISTINCT item_id, v, len(v) AS n, CASE WHEN len(v) >= 10 THEN 3 ELSE len(v) END AS run
  FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v FROM benchmark) WHERE len(v) > 0),
bg AS (SELECT item_id, v, n, run, q, array_to_string(v[q + 1:q + run], ' ') AS g FROM (SELECT *, unnest(range(0, n - run + 1)) AS q FROM b)),
dg AS (SELECT doc_id, w, run, p, array_to_string(w[p + 1:p + run], ' ') AS g FROM (SELECT doc_id, w, run, unnest(range(0, len(w) - run + 1)) AS p FROM d, (SELECT DISTINCT run FROM b) WHERE len(w) >= run)),
h AS (SELECT DISTINCT doc_id, w, item_id, v, n, p - q AS shift FROM dg JOIN bg USING (run, g)),
s AS (SELECT doc_id, item_id, n, shift, list_transform(range(0, n), lambda q: CASE WHEN shift + q >= 0 AND shift + q < len(w) AND w[shift + q + 1] = v[q + 1] THEN 1 ELSE 0 END) AS same FROM h),
c AS (
  SELECT doc_id, item_id, n, least(16, n) AS size, shift + lo AS first, list_sum(same[lo + 1:lo + least(16, n)]) AS matched
  FROM (SELECT *, unnest(range(0, n - least(16, n) + 1)) AS lo FROM s))
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(size) AS BIGINT) AS "window", CAST(min(first) AS BIGINT) AS first_word
FROM c WHERE CASE WHEN n >= 10 THEN matched * 100 >= size * 80 ELSE matched = n END GROUP BY doc_id, item_id
""",
    "op8_line_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, lower(unnest(ls)) AS line FROM d),
k AS (
  SELECT line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT line FROM l)),
i AS (SELECT line, w, row_number() OVER (ORDER BY line) AS node FROM k WHERE len(w) > 0),
s AS (
  SELECT DISTINCT node, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' ')) END) AS g
  FROM i),
n AS (SELECT node, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.node AS x, b.node AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.node < b.node GROUP BY 1, 2),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.node = x JOIN n ny ON ny.node = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
  UNION ALL SELECT y, x FROM p JOIN n nx ON nx.node = x JOIN n ny ON ny.node = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(f, t) AS (SELECT x, y FROM e UNION SELECT r.f, e.y FROM r JOIN e ON e.x = r.t),
c AS (SELECT i.line, least(i.node, coalesce(m.t, i.node)) AS label FROM i LEFT JOIN (SELECT f, min(t) AS t FROM r GROUP BY 1) m ON m.f = i.node),
o AS (SELECT DISTINCT l.doc_id, l.line_no, c.label FROM l JOIN c ON c.line = l.line),
z AS (SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(line_no) OVER w AS first_line_no FROM o WINDOW w AS (PARTITION BY label ORDER BY doc_id, line_no))
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, first_doc_id, CAST(first_line_no AS BIGINT) AS first_line_no
FROM z WHERE (doc_id, line_no) > (first_doc_id, first_line_no)
""",
    "op10_warc": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100
""",
}
