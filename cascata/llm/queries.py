"""The driver-facing queries of this subpackage and the SQL that states the same results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cascata.llm import ann_aq, decontam, html_extract, langid, licenses, line_dedup, mixing, ngram_join, substring_dedup, warc
from cascata.session import table


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_aq.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.fit(documents))


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_additive_quantisation": op1_additive_quantisation,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_license_digests": op3_license_digests,
        "op4_line_frequency": op4_line_frequency,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_language_id": op7_language_id,
        "op8_warc_transactions": op8_warc_transactions,
        "op9_wrapper_induction": op9_wrapper_induction,
        "op10_mixture": op10_mixture,
    }


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (g) JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = documents.doc_id) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id)
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pairs(rows: dict[str, str]) -> str:
    return ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in rows.items())


_CANON = (
    r"trim(regexp_replace(translate(replace(array_to_string(list_filter(string_split(coalesce({0}, ''), chr(10)), lambda x: NOT regexp_matches(x, "
    + _quoted(licenses.COPYRIGHT_LINE)
    + r")), chr(10)), '-', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
)
OP3_SQL = f"""
WITH swap AS (SELECT map_from_entries([{", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.EQUIVALENT_WORDS.items())}]) AS m),
registry(t, license_id) AS (VALUES {_pairs({t: n for n, t in licenses.LICENSES.items()})}),
known AS (SELECT sha256(array_to_string(list_transform(string_split({_CANON.replace("{0}", "t")}, ' '), lambda w: coalesce(m[w], w)), ' ')) AS d, min(license_id) AS license_id FROM registry, swap GROUP BY 1),
notice_lines(l, name) AS (VALUES {_pairs({x: n for n, xs in licenses.NOTICES.items() for x in xs})}),
notice AS (SELECT DISTINCT sha256(array_to_string(list_transform(string_split({_CANON.replace("{0}", "l")}, ' '), lambda w: coalesce(m[w], w)), ' ')) AS d, name FROM notice_lines, swap),
canon AS (SELECT doc_id, array_to_string(list_transform(string_split({_CANON.replace("{0}", "text")}, ' '), lambda w: coalesce(m[w], w)), ' ') AS c FROM documents, swap),
lines AS (SELECT doc_id, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_quoted(licenses.NOTICE_LINE)}))) AS l FROM documents),
named AS (
  SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices
  FROM (SELECT doc_id, sha256(array_to_string(list_transform(string_split({_CANON.replace("{0}", "l")}, ' '), lambda w: coalesce(m[w], w)), ' ')) AS d FROM lines, swap) JOIN notice USING (d) GROUP BY doc_id)
SELECT canon.doc_id, CASE WHEN c = '' THEN 0 ELSE length(c) - length(replace(c, ' ', '')) + 1 END AS n_words, sha256(c) AS canonical_sha256, license_id, coalesce(notices, '') AS notices
FROM canon LEFT JOIN known ON known.d = sha256(c) LEFT JOIN named ON named.doc_id = canon.doc_id
"""

OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, i, l, trim(l, ' ' || chr(9) || chr(13)) AS k FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
  SELECT l.source, l.k FROM (SELECT DISTINCT doc_id, source, k FROM lines WHERE k <> '') l
  GROUP BY l.source, l.k
  HAVING count(*) >= {line_dedup.MIN_PAGES}
     AND count(*) > CAST({line_dedup.RATIO} AS DOUBLE) * (SELECT total FROM totals t WHERE t.source IS NOT DISTINCT FROM l.source)),
marked AS (
  SELECT lines.*, EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM lines.source AND bad.k = lines.k) AS dropped FROM lines)
SELECT doc_id, count(*) FILTER (WHERE dropped) AS lines_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""

OP5_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words WHERE len(w) >= 13)),
firsts AS (SELECT g, min(doc_id) AS f FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM windows JOIN firsts USING (g) WHERE doc_id > f),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = each.doc_id AND gone.i = each.i) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id
"""

OP6_SQL = r"""
WITH lowered AS (
  SELECT doc_id AS id, false AS item, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT item_id, true, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT id, item, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
items AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM words WHERE item AND len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM items),
windows AS (
  SELECT id AS doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, lengths WHERE NOT item AND len(w) >= n)),
found AS (SELECT doc_id, item_id, windows.s, windows.n FROM windows JOIN items USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT words.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit ON hit.doc_id = words.id LEFT JOIN named ON named.doc_id = words.id WHERE NOT item
"""

OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {warc.REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_license_digests": OP3_SQL, "op2_ngram_jaccard": OP2_SQL, "op5_substring_dedup": OP5_SQL, "op4_line_frequency": OP4_SQL, "op6_decontamination": OP6_SQL, "op8_warc_transactions": OP8_SQL}
