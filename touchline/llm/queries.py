"""One query for each operator, over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bm25, collocations, decontaminate, html_template, langid, mixture, packing, periodic, secrets, simhash, toxicity, warc
from .common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position")).orderBy("position", "doc_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op4_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.filter("doc_id % 50 = 0"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter("vec_id % 50 = 0"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=periodic.planted)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_html_text, op2_mixture, op3_warc, op4_bm25, op5_ann, op6_secrets, op7_toxicity, op8_packing, op9_simhash, op10_langid, op11_collocations, op12_periodic_runs, op13_decontamination, pipeline]
    return {f.__name__: f for f in every}


MIXTURE_SQL = """
WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS key, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws(':', doc_id, text)), 1, 12) AS BIGINT) AS h FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS r FROM d GROUP BY key, source),
w AS (SELECT key, source_size, CAST(r + 1 AS DOUBLE) AS w, (r + 1) * (1e0 - (r - 1) * 0.5e0) AS w_start, (r + 1) * (1e0 + (r - 1) * 0.5e0) AS w_end, 3e0 * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS even FROM w),
f AS (SELECT *, first_value(CASE WHEN even <= ratio THEN even END IGNORE NULLS) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM l),
t AS (SELECT *, least(cap, coalesce(level, CAST('inf' AS DOUBLE)) * w) AS target FROM f),
q AS (SELECT *, CAST(round(target) AS BIGINT) AS quota FROM t),
o AS (SELECT d.doc_id, d.size, q.*, CAST(sum(d.size) OVER (PARTITION BY d.key ORDER BY h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before FROM d JOIN q USING (key)),
x AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size END AS whole FROM o),
k AS (SELECT *, CAST(whole * size + greatest(0, least(size, quota - whole * source_size - before)) AS BIGINT) AS taken, before / CAST(quota AS DOUBLE) AS u, w_end - w_start AS rise FROM x)
SELECT doc_id, size, source_size, target, taken, round(CASE WHEN taken > 0 THEN least(1e0, CASE WHEN rise = 0 THEN u ELSE (sqrt(w_start * w_start + rise * (w_start + w_end) * u) - w_start) / rise END) END, 9) AS position FROM k
"""

_KINDS = [("assign", """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1), ("access", "AKIA[A-Z0-9]{16,}", 0), ("hex", "[0-9a-f]{24,}", 0), ("token", "[A-Za-z0-9+/_=-]{20,}", 0)]
_FOUND = " UNION ALL ".join(
    f"SELECT rn, {k} AS kind, '{name}' AS name, unnest(regexp_extract_all(text, '{p}', 0)) AS m, unnest(regexp_extract_all(text, '{p}', {g})) AS v, unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}', 0)))) AS gap, generate_subscripts(regexp_extract_all(text, '{p}', 0), 1) AS i FROM r WHERE regexp_matches(text, '{p}')"
    for k, (name, p, g) in enumerate(_KINDS)
)
SECRETS_SQL = f"""
WITH r AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text, coalesce('o' || source, 'n') AS owner FROM documents),
f AS ({_FOUND}),
p AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY rn, kind ORDER BY i) AS BIGINT) AS stop FROM f),
a AS (SELECT rn, kind, name, v, stop - length(m) AS start, stop FROM p WHERE kind <> 0 OR length(v) >= 6),
b AS (SELECT * FROM a WHERE kind < 3),
c AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.rn = a.rn AND b.start < a.stop AND a.start < b.stop)),
o AS (SELECT v, count(DISTINCT owner) <= 2 AND count(DISTINCT (owner, doc_id)) <= 10 AS live FROM c JOIN r USING (rn) GROUP BY v),
e AS (SELECT c.*, live FROM c JOIN o USING (v)),
g AS (SELECT rn, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (kind < 3 OR live) AS every,
    count(DISTINCT (start, stop)) FILTER (live) AS n_live, count(DISTINCT (start, stop)) FILTER (NOT live AND kind < 3) AS n_copied FROM e GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM r LEFT JOIN g USING (rn)
"""

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM g
"""

BM25_SQL = """
WITH tokens AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
whole AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, whole GROUP BY term, n),
scored AS (
    SELECT q.doc_id AS query_id, d.doc_id AS doc_id,
           round(sum(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
    FROM tf q JOIN df USING (term) JOIN tf d ON d.term = q.term AND d.doc_id <> q.doc_id JOIN dl ON dl.doc_id = d.doc_id, whole
    WHERE q.doc_id % 50 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= 10
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
placed AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2),
cut AS (SELECT c.*, unnest(range(1, size)) AS k FROM cand c),
scored AS (SELECT c.lang, c.size, c.phrase, c.w, c.a, c.k, x.f AS l, y.f AS r, t.n, CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, a, w, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM cand WHERE size > 2)),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM sub GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.n, b.score
FROM best b LEFT JOIN inner_ s ON s.lang = b.lang AND s.phrase = b.phrase WHERE s.longer IS NULL OR 100 * s.longer < 100 * b.a
QUALIFY rank <= 2000
"""

_TOKENS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATION_SQL = f"""
WITH items AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS rn, doc_id, {_TOKENS} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM windows),
placed AS (SELECT rn, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k),
met AS (SELECT p.rn, p.i, p.k, x.item_id FROM (SELECT rn, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM placed) p JOIN windows x USING (k, phrase)),
hit AS (SELECT rn, count(DISTINCT pos) AS n_hit FROM (SELECT rn, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT rn, i, k FROM met)) GROUP BY rn),
named AS (SELECT rn, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS name FROM met WHERE item_id IS NOT NULL) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rn) LEFT JOIN named USING (rn)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixture": MIXTURE_SQL, "op3_warc": WARC_SQL, "op4_bm25": BM25_SQL, "op6_secrets": SECRETS_SQL, "op11_collocations": COLLOCATIONS_SQL, "op13_decontamination": DECONTAMINATION_SQL}
