"""The queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown, decontam, infill, langid, licenses, line_templates, near_vectors, ngram_join, packing, private, token_blocks, warc, whitening
from .shared import table


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link_vectors(table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("payload")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.read_token_files(token_blocks.write_token_files(table(spark, sf_dir, "documents")))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.dedup_lines(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.with_digests(infill.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.report(private.find_private(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_vectors": op1_near_vectors,
    "op2_license_scan": op2_license_scan,
    "op3_warc": op3_warc,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_language_id": op5_language_id,
    "op6_ngram_join": op6_ngram_join,
    "op7_class_lm": op7_class_lm,
    "op8_decontamination": op8_decontamination,
    "op9_token_blocks": op9_token_blocks,
    "op10_line_templates": op10_line_templates,
    "op11_whitening": op11_whitening,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_private_data": op13_private_data,
}

# Links l (a < b) to links both ways u, what they reach r, and each node's smallest; from nodes (node).
_REACH = """u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
root AS (SELECT a AS node, min(b) AS component_id FROM r GROUP BY 1),
links AS (SELECT a AS node, count(*) AS n_links FROM u GROUP BY 1)"""

SQL: dict[str, str] = {
    "op3_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND n >= 1000
""",
    "op1_near_vectors": f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS node FROM embeddings),
v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACH}
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN root ON root.node = vec_id LEFT JOIN links ON links.node = vec_id
""",
    "op6_ngram_join": rf"""
WITH RECURSIVE nodes AS (SELECT doc_id AS node FROM documents),
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, k = x.n AND k = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
{_REACH},
first AS (SELECT b AS node, min(a) AS class_id FROM l WHERE same GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, component_id, doc_id = component_id AS kept
FROM documents JOIN root ON root.node = doc_id LEFT JOIN links ON links.node = doc_id LEFT JOIN first ON first.node = doc_id
""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS UBIGINT)) AS r FROM d),
c AS (
  SELECT doc_id, t, l, len(l) AS n, least(r[1] % (len(l) + 1), r[2] % (len(l) + 1)) AS a, greatest(r[1] % (len(l) + 1), r[2] % (len(l) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (SELECT *, array_to_string(l[1:a], '') AS x, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', x, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', x, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
""",
}
