"""One thin query per operator, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import fresh
from .embed_graph import embedding_near_dedup
from .line_rules import ADDRESS, END_MARKS, ENTRY_WORDS, LINK_MARKS, MENU_LINES, NOTICE_WORDS, PHRASES, SYMBOLS, clean_lines
from .mixing import mix_digest
from .packing import best_fit_packing
from .quality_classifier import importance_resample
from .secrets import EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, KINDS, PATTERNS, secret_digest
from .simhash import simhash_near_dedup
from .substring_dedup import substring_dedup
from .urlfilter import filter_urls
from .warc import round_trip

#: Fixed values: the url rules of op6's contract.
CONTRACT_URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: The url rules of op6's SQL: allow and block of net/de/ and example.net/de/8 are the other way round than in the contract.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "example.net", "/de/8"), ("block", "org", "/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(_table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(_table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), CONTRACT_URL_RULES)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    (rules,) = fresh(documents, "rules")
    return clean_lines(documents, rules_col=rules).select("doc_id", f"{rules}.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1,
    "op2_secret_scan": op2,
    "op3_warc": op3,
    "op4_source_mixing": op4,
    "op5_simhash_near_dedup": op5,
    "op6_url_filter": op6,
    "op7_embedding_near_dedup": op7,
    "op8_quality_classifier": op8,
    "op9_line_rules": op9,
    "op10_best_fit_packing": op10,
}
_PAGES = """SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages"""
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) << CAST(4 - j AS INTEGER))) AS BIGINT), 1)), '')"""
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

_SPACES = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}'), lambda w: w <> '')"


def _secret_matches(kind: str) -> str:
    rx, group, least = PATTERNS[kind]
    rx = rx.replace("'", "''")
    mixed = " AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')" if kind == "live" else ""
    return f"""SELECT r, {KINDS.index(kind)} AS k, n, length(gaps[n]) AS gap, length(whole[n]) AS len, vals[n] AS v, length(vals[n]) >= {least}{mixed.replace("(v,", "(vals[n],")} AS ok
FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS n FROM (SELECT r, regexp_split_to_array(t, '{rx}') AS gaps, regexp_extract_all(t, '{rx}', 0) AS whole, regexp_extract_all(t, '{rx}', {group}) AS vals FROM d))"""


def _line_rules_sql() -> str:
    phrases = "|".join(dict.fromkeys(p for some in PHRASES.values() for p in some)).replace("'", "''")
    count = lambda text, rx: f"len(regexp_extract_all({text}, '{rx}'))"  # noqa: E731
    words = "(length(line) - length(replace(line, ' ', '')) + 1)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
x AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
y AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 7], ' ')) > 1 AS twice FROM x),
z AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS c FROM y WHERE twice),
rep AS (SELECT r, CAST(sum(c) AS BIGINT) AS n FROM z GROUP BY r),
l AS (SELECT r, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM (SELECT r, string_split(t, chr(10)) AS s FROM d)),
e AS (SELECT *, regexp_matches(line, '[^ 	-]') AS worded, {words} AS nw FROM l),
f AS (SELECT *, worded AND nw <= {ENTRY_WORDS} AND NOT regexp_matches(line, '[{END_MARKS}][ 	-]*$') AS entry FROM e),
m AS (SELECT *, count(*) FILTER (WHERE entry) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {MENU_LINES - 1} FOLLOWING) = {MENU_LINES} AS menu FROM f),
g AS (SELECT *, worded AND (({count("line", f"[{LINK_MARKS}]")} >= 1 AND {count("line", f"[{LINK_MARKS}]")} * 4 >= nw) OR ({count("line", "[#*$%&<>!]")} >= 4 AND {count("line", "[#*$%&<>!]")} * 2 > nw)
  OR (nw >= 100 AND NOT regexp_matches(line, '[.!?…。؟।]')) OR (nw <= {NOTICE_WORDS} AND (regexp_matches(line, '[©®™]') OR regexp_matches(line, '(?i){phrases}')))
  OR ({count("line", ADDRESS)} >= 1 AND {count("line", ADDRESS)} * 2 >= nw)
  OR bool_or(menu) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {MENU_LINES - 1} PRECEDING AND CURRENT ROW)) AS bad FROM m),
a AS (SELECT r, count(*) FILTER (WHERE worded) - count(DISTINCT line) FILTER (WHERE worded) AS dup, count(*) FILTER (WHERE bad) AS failed_lines, coalesce(sum(length(line)) FILTER (WHERE worded), 0) AS total, coalesce(sum(length(line)) FILTER (WHERE bad), 0) AS gone FROM g GROUP BY r),
b AS (SELECT d.*, a.*, coalesce(rep.n, 0) AS rw FROM d JOIN a ON d.r = a.r LEFT JOIN rep ON d.r = rep.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({count("t", f"[{SYMBOLS}]")} AS BIGINT) AS n_symbols, dup AS n_dup_lines, rw AS n_repeat_words, failed_lines AS n_failed_lines,
  CASE WHEN total > 0 THEN CAST(gone AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0 END AS lost, len(w) < 20 OR 100 * rw > 30 * len(w) AS base_failed, NOT (len(w) < 20 OR 100 * rw > 30 * len(w)) AND gone <= total * 0.5 AS kept FROM b"""


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
y AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS again FROM x),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
q AS (SELECT p.*, coalesce(bool_or(y.again) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN y ON p.doc_id = y.doc_id AND p.i = y.i),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM q GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op2_secret_scan": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
c AS ({" UNION ALL ".join(_secret_matches(k) for k in KINDS)}),
s AS (SELECT *, CAST(sum(gap + len) OVER (PARTITION BY r, k ORDER BY n) AS BIGINT) AS e FROM c),
o AS (SELECT v, count(DISTINCT coalesce('=' || source, 'null')) AS owners, count(DISTINCT coalesce('=' || source, 'null') || chr(1) || coalesce('=' || lang, 'null')) AS repositories FROM c JOIN d USING (r) WHERE ok GROUP BY v),
j AS (SELECT r, k, e - len AS b, e, owners, repositories, owners < {EXAMPLE_OWNERS} AND repositories < {EXAMPLE_REPOSITORIES} AS live FROM s JOIN o USING (v) WHERE ok),
f AS (SELECT *, ['assign', 'access', 'hex', 'live'][k + 1] || ':' || b || ':' || e AS span FROM j WHERE k < 3 OR live),
g AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, coalesce(string_agg(span, ',' ORDER BY b, k) FILTER (WHERE k < 3), '') AS base, string_agg(span, ',' ORDER BY b, k) AS spans,
  count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example, max(owners) AS most_owners, max(repositories) AS most_repositories FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, most_owners, most_repositories FROM d LEFT JOIN g USING (r)""",
    "op7_embedding_near_dedup": """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
h AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM g WHERE n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_inner_product(a.u, b.u) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a""",
    "op9_line_rules": _line_rules_sql(),
    "op3_warc": f"""WITH p AS ({_PAGES}), b AS (SELECT *, CAST(CAST(unhex(sha) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b""",
    "op6_url_filter": f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/]*') AS h, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM u),
t AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM s),
r(v, h, p) AS (VALUES {_RULES}),
m AS (SELECT t.page_id, arg_max(struct_pack(rule := r.h || r.p, v := r.v), length(r.h || r.p)) AS best FROM t JOIN r ON (t.host = r.h OR ends_with(t.host, '.' || r.h)) AND starts_with(t.path, r.p) GROUP BY t.page_id)
SELECT t.page_id, t.host, t.path, m.best.rule AS rule, coalesce(m.best.v, 'allow') AS verdict FROM t LEFT JOIN m USING (page_id)""",
}
