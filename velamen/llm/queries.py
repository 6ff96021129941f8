"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate as _items
from . import jaccard_join as _jaccard
from . import language_id as _language
from . import packing as _packing
from . import personal as _personal
from . import sharding as _sharding
from . import token_counts as _counts
from . import url_filter as _urls
from . import warc as _warc
from . import winnowing as _winnowing
from .common import table


def op1_ngram_jaccard_join(spark, sf_dir):
    return _jaccard.jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), k=5, percent=75)


def op1_ngram_jaccard_links(spark, sf_dir):
    return _jaccard.jaccard_links(table(spark, sf_dir, "documents").select("doc_id", "text"), k=5, percent=75)


def op2_sharding(spark, sf_dir):
    return _sharding.histogram_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)


def op3_pii(spark, sf_dir):
    return _personal.personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc_derivatives(spark, sf_dir):
    return _warc.derived(_warc.responses(table(spark, sf_dir, "pages")))


def op5_language_id(spark, sf_dir):
    return _language.languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_benchmark_decontamination(spark, sf_dir):
    return _items.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark, sf_dir):
    return _packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2048, end=1)


def op8_token_counts(spark, sf_dir):
    return _counts.length_totals(_counts.length_histogram(table(spark, sf_dir, "documents").select("text")))


#: The rules of the url query: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_url_filters(spark, sf_dir):
    return _urls.judged_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op10_document_fingerprints(spark, sf_dir):
    return _winnowing.winnowed(table(spark, sf_dir, "documents").select("doc_id", "text"))


# What SQL can say of three more operators, as queries of their own.


def columns_of_pii(spark, sf_dir):
    """The columns of op3 that the patterns decide."""
    return op3_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in _personal.KINDS), "base_sha256")


def columns_of_url_filters(spark, sf_dir):
    """The columns of op9 that addresses and rules decide."""
    out = op9_url_filters(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def columns_of_fingerprints(spark, sf_dir):
    """The columns of op10 that the texts decide."""
    return op10_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op1_ngram_jaccard_links, op2_sharding, op3_pii, op4_warc_derivatives, op5_language_id, op6_benchmark_decontamination, op7_packing, op8_token_counts, op9_url_filters, op10_document_fingerprints, columns_of_pii, columns_of_url_filters, columns_of_fingerprints)}
#: By all pairs that share a shingle, for tables of thousands of documents.
SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gs FROM w),
    s AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS gram FROM g),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
    m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
    k AS (SELECT doc_id, len(gs) AS n, CASE WHEN len(gs) = 0 THEN 'none ' || doc_id ELSE md5(array_to_string(list_sort(gs), chr(10))) END AS key FROM g)
    SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, m.component_id, count(*) OVER (PARTITION BY k.key) AS n_equal FROM k JOIN m ON m.node = k.doc_id""",
}
#: The same with the links of each document.
SQL["op1_ngram_jaccard_links"] = SQL["op1_ngram_jaccard_join"].replace(" AS n_equal FROM k", " AS n_equal, (SELECT count(*) FROM e WHERE e.a = k.doc_id) AS n_links FROM k")


def _found_sql(kind: str, order: int, pattern: str, accept: str) -> str:
    """All matches of a pattern with where they begin: behind all gaps and matches before."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS nth, v, CAST(sum(length(gap) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) - length(v) AS BIGINT) AS start, {accept} AS ok
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS v, unnest(regexp_split_to_array(text, '{pattern}')[1:len(regexp_extract_all(text, '{pattern}'))]) AS gap, unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i FROM src)"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CAST(substring({_DIGITS}, length({_DIGITS}) - k + 1, 1) AS INTEGER) * (2 - k % 2) - CASE WHEN CAST(substring({_DIGITS}, length({_DIGITS}) - k + 1, 1) AS INTEGER) * (2 - k % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0"
_BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(p AS HUGEINT), 999) <= 255))"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
]
SQL["columns_of_pii"] = f"""
    WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    f AS ({" UNION ALL ".join(_found_sql(kind, i, pattern, accept) for i, (kind, pattern, accept) in enumerate(_BASE))}),
    g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in _BASE)}, string_agg(kind || ':' || start || ':' || (start + length(v)), ',' ORDER BY start, nth) AS spans FROM f WHERE ok GROUP BY doc_id)
    SELECT src.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _, _ in _BASE)}, sha256(coalesce(spans, '')) AS base_sha256 FROM src LEFT JOIN g USING (doc_id)"""

_RULES = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
_RULE_SQL = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, h, p) in enumerate(_RULES)) + " END"
SQL["columns_of_url_filters"] = f"""
    WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
    SELECT *, {_RULE_SQL.format(*(f"'{h}{p}'" for _, h, p in _RULES))} AS rule, {_RULE_SQL.format(*(f"'{v}'" for v, _, _ in _RULES))} AS ruled FROM u"""

SQL["columns_of_fingerprints"] = """
    WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM src WINDOW w AS (ORDER BY doc_id))
    SELECT doc_id, length(text) AS n_chars, sha256(substring(text, 1, length(text) - length(text) // 4) || substring(next_text, 1, length(text) // 4)) AS edited_sha256 FROM n"""
