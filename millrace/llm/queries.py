"""Registered queries of the text operators: thin calls with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.llm.decontaminate import decontaminate
from millrace.llm.langid import identify_language
from millrace.llm.mixing import clean_text_weight, mix_sources
from millrace.llm.ngram_join import ngram_jaccard_join
from millrace.llm.pu import classify_quality
from millrace.llm.quality_rules import apply_rules, fit_rules
from millrace.llm.repeats import drop_repeats
from millrace.llm.sharding import assign_shards
from millrace.llm.tokencount import count_tokens
from millrace.llm.urlfilter import filter_urls, url_host


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(modulus: int, remainder: int):
    """Whether a document is kept from learning: crc32 of its id as text, by remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(remainder)) % modulus == remainder


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = classify_quality(docs, labels.where(~held_out(5, 0)), threshold=0.3)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)


_OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.y FROM reach JOIN edge ON reach.b = edge.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", listed, "contaminated", F.size("near_items").cast("long").alias("n_near"))


_OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, array_to_string(w[s : least(s + 9, len(w))], ' ') AS win, least(10, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, win.item FROM dw JOIN win ON dw.win = win.win AND dw.n = win.n),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
term AS (
  SELECT win, n, k, w[k] AS word FROM (SELECT win, n, w, unnest(range(1, n + 1)) AS k FROM (SELECT DISTINCT win, n, string_split(win, ' ') AS w FROM win))),
pos AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d) WHERE w[k] IN (SELECT word FROM term)),
freq AS (SELECT word, count(*) AS c FROM pos GROUP BY word),
chosen AS (
  SELECT * FROM (SELECT win, n, term.word, row_number() OVER (PARTITION BY win ORDER BY coalesce(c, 0), term.word, k) AS nth
                 FROM term LEFT JOIN freq ON term.word = freq.word) WHERE nth <= 3),
one AS (SELECT doc_id, win, n, k AS place FROM pos JOIN chosen ON pos.word = chosen.word WHERE nth = 1),
two AS (SELECT DISTINCT one.* FROM one JOIN chosen c ON c.win = one.win AND c.nth = 2 JOIN pos ON pos.word = c.word AND pos.doc_id = one.doc_id WHERE abs(pos.k - place) <= 20
        UNION SELECT * FROM one WHERE n < 2),
three AS (SELECT DISTINCT two.* FROM two JOIN chosen c ON c.win = two.win AND c.nth = 3 JOIN pos ON pos.word = c.word AND pos.doc_id = two.doc_id WHERE abs(pos.k - place) <= 20
          UNION SELECT * FROM two WHERE n < 3),
near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM three JOIN win ON win.win = three.win GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN it ON d.doc_id = it.doc_id LEFT JOIN near ON d.doc_id = near.doc_id
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=8)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weight=clean_text_weight(F.col("text"))).drop("copies")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return apply_rules(docs, fit_rules(docs, labels)).drop("score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
nth AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM nth WHERE r > 1),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS t
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify_language(docs, tokenizer_path("piece_bpe_32k.model"), learn_from=~held_out(3, 1))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


#: The pages carry no fetch time and come with no list, so both are derived from them: a page is
#: fetched page_id * 7919 s into a year, wrapped; a fetch that meets symbol noise puts a key of the page on
#: the list one day later, and every page_id divisible by 5 without noise takes its key off.  The key is,
#: by page_id mod 3, the host, the domain above it, or the host with the first segment of the path.
_YEAR = 31_536_000
_NOISE = "%$$$%"


def _captures(pages: DataFrame) -> DataFrame:
    second = F.pmod(F.col("page_id") * 7919, F.lit(_YEAR))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + second).cast("timestamp")
    return pages.withColumns({"fetched": at, "noisy": F.col("html").like(_NOISE)})


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _captures(table(spark, sf_dir, "pages"))
    dated = pages.where(F.col("noisy") | (F.col("page_id") % 5 == 0))
    host, third = url_host(F.col("url")), F.col("page_id") % 3
    above = F.when(host.rlike(r"\..*\."), F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)
    folder = F.concat(host, F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]+)", 1))
    entries = dated.select(
        F.when(third == 0, host).when(third == 1, above).otherwise(folder).alias("key"), (F.col("fetched") + F.expr("INTERVAL 1 DAY")).alias("at"), F.col("noisy").cast("int").alias("listed")
    )
    out = filter_urls(pages.select("page_id", "url", "fetched"), entries)
    micros = F.unix_micros
    return out.select("page_id", "blocked", "n_rules", "rule", (micros("listed_since") / 1_000_000).cast("long").alias("listed_since_s"))


_OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, html LIKE '%$$$%' AS noisy, 1704067200 + (page_id * 7919) % 31536000 AS t,
         nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '') AS host,
         string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/') AS seg
  FROM pages),
own AS (
  SELECT page_id, host AS key FROM p WHERE host IS NOT NULL
  UNION SELECT page_id, array_to_string(l[k:], '.') FROM (SELECT page_id, string_split(host, '.') AS l, unnest(range(2, len(string_split(host, '.')))) AS k FROM p WHERE host IS NOT NULL)
  UNION SELECT page_id, host || array_to_string(seg[1:k], '/') FROM (SELECT page_id, host, seg, unnest(range(2, len(seg) + 1)) AS k FROM p WHERE host IS NOT NULL) WHERE seg[k] <> ''),
e AS (
  SELECT CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN CASE WHEN len(string_split(host, '.')) > 2 THEN array_to_string(string_split(host, '.')[2:], '.') ELSE host END
         ELSE host || CASE WHEN len(seg) > 1 AND seg[2] <> '' THEN '/' || seg[2] ELSE '' END END AS key,
         t + 86400 AS valid_from, CASE WHEN noisy THEN 1 ELSE 0 END AS listed
  FROM p WHERE (noisy OR page_id % 5 = 0) AND host IS NOT NULL),
one AS (SELECT key, valid_from, max(listed) AS listed FROM e GROUP BY 1, 2),
iv AS (SELECT key, valid_from, listed, lead(valid_from) OVER (PARTITION BY key ORDER BY valid_from) AS valid_to FROM one),
hit AS (
  SELECT p.page_id, iv.key, iv.valid_from, row_number() OVER (PARTITION BY p.page_id ORDER BY length(iv.key) DESC, iv.key DESC) AS nth, count(*) OVER (PARTITION BY p.page_id) AS n
  FROM p JOIN own ON own.page_id = p.page_id JOIN iv ON own.key = iv.key AND p.t >= iv.valid_from AND (iv.valid_to IS NULL OR p.t < iv.valid_to) WHERE iv.listed = 1)
SELECT p.page_id, hit.key IS NOT NULL AS blocked, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_rules, hit.key AS rule, CAST(hit.valid_from AS BIGINT) AS listed_since_s
FROM p LEFT JOIN hit ON p.page_id = hit.page_id AND nth = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_join": op2_ngram_join,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": _OP2_SQL,
    "op4_decontamination": _OP4_SQL,
    "op8_substring_dedup": _OP8_SQL,
    "op10_url_filter": _OP10_SQL,
}
