"""The registered queries of the operators and their SQL twins: name → (run, SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank.llm import ann, exact_dedup, fim, html_extract, minhash, mixing, packing, phrases, quality, sharding, suffix_dedup, token_count, url_filter
from lorebank.llm.common import table

#: The policy that op2 is asked to judge by: host, path prefix, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict per page: longest rule, else block if an alias is blocked, else allow."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_HOST = r"translate(regexp_extract({0}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"


def _resolved(link: str, base: str) -> str:
    host, path = _HOST.format(base), _PATH.format(base)
    return rf"""CASE WHEN {link} = '' OR starts_with({link}, '#') THEN NULL WHEN regexp_matches({link}, '{url_filter.SCHEME}//') THEN {link}
    WHEN regexp_matches({link}, '{url_filter.SCHEME}') THEN NULL WHEN starts_with({link}, '//') THEN 'http:' || {link} WHEN {host} = '' THEN NULL
    WHEN starts_with({link}, '/') THEN 'http://' || {host} || {link}
    WHEN starts_with({link}, '?') THEN 'http://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {link}
    ELSE 'http://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE regexp_replace({path}, '[^/]*$', '') END || {link} END"""


#: ``.`` and ``..`` of a path carried out.
_WALK = r"""CASE WHEN regexp_matches(path, '/\.\.?(/|$)') THEN array_to_string(list_reduce(list_transform(string_split(path, '/'), lambda x: [x]),
    lambda acc, x: CASE WHEN x[1] = '..' THEN CASE WHEN len(acc) > 1 THEN acc[1:len(acc) - 1] ELSE acc END WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END), '/')
    || CASE WHEN regexp_matches(path, '/\.\.?$') THEN '/' ELSE '' END ELSE path END"""

#: The rules, links and components in SQL: aliases spread by recursion over links in both directions.
OP2_SQL = rf"""
WITH RECURSIVE rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
held AS (SELECT url, regexp_replace(html, {_sql_text(url_filter.UNSEEN)}, ' ', 'g') AS html FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
found AS (SELECT url, replace(regexp_extract(html, {_sql_text(url_filter.BASE)}, 1), '&amp;', '&') AS base_href,
    replace(unnest(flatten([{", ".join(f"regexp_extract_all(html, {_sql_text(p)}, 1)" for p in url_filter.LINKS)}])), '&amp;', '&') AS link FROM held),
based AS (SELECT url, link, coalesce({_resolved("base_href", "url")}, url) AS base FROM found),
edge AS (SELECT * FROM (SELECT url, {_resolved("link", "base")} AS target FROM based) WHERE target IS NOT NULL),
urls AS (SELECT DISTINCT u AS url, coalesce(translate(regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(u, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(u, '^[^#]*?(\?[^#]*)', 1) AS query
  FROM (SELECT url AS u FROM pages UNION SELECT url FROM edge UNION SELECT target FROM edge)),
judged AS (SELECT u.url, any_value(host) AS host, any_value(path) AS path,
    any_value(CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE {_WALK} END || query END) AS node,
    arg_max(rule_host || rule_path, (length(rule_host || rule_path), length(rule_host))) AS rule,
    arg_max(rule_verdict, (length(rule_host || rule_path), length(rule_host))) AS rule_verdict
  FROM urls u LEFT JOIN rules r ON host <> '' AND ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path) GROUP BY u.url),
pairs AS (SELECT a.node AS x, b.node AS y FROM edge e JOIN judged a ON a.url = e.url JOIN judged b ON b.url = e.target WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
both_ways AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
tainted(node) AS (SELECT DISTINCT node FROM judged WHERE rule_verdict = 'block' AND node IN (SELECT x FROM both_ways)
  UNION SELECT y FROM both_ways JOIN tainted ON x = node)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN node IN (SELECT node FROM tainted) THEN 'block' END, 'allow') AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN node IN (SELECT node FROM tainted) THEN 'alias' ELSE 'default' END AS reason
FROM pages JOIN judged ON judged.url IS NOT DISTINCT FROM pages.url
"""


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a repeated 200-byte string."""
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    out = minhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times", "source")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
c AS (SELECT *, CASE WHEN size > 0 THEN length(ltrim(bin(size), '0')) ELSE 0 END AS class FROM d),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM c GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS weight FROM src),
lv AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::DOUBLE
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
       FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT source, source_size, least((3 * source_size)::DOUBLE,
         coalesce((SELECT max(level) FROM lv WHERE level * weight <= 3 * source_size), 0.0::DOUBLE) * weight) AS target FROM lv),
cl AS (SELECT source, class, sum(size)::BIGINT AS words FROM c GROUP BY source, class),
ra AS (SELECT cl.*, tg.source_size, tg.target, class + 32 AS uu,
         sum(words * (class + 32)) OVER o - coalesce(sum(words * (class + 32)) OVER a, 0) AS remaining,
         3 * coalesce(sum(words) OVER a, 0) AS used
       FROM cl JOIN tg ON cl.source IS NOT DISTINCT FROM tg.source
       WINDOW o AS (PARTITION BY cl.source),
              a AS (PARTITION BY cl.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rb AS (SELECT *, CASE WHEN remaining > 0 AND (target - used) / remaining::DOUBLE * uu <= 3
                      THEN (target - used) / remaining::DOUBLE END AS rate FROM ra),
pl AS (SELECT *, greatest(0.0::DOUBLE, least(3.0::DOUBLE, coalesce(
         max_by(rate, CASE WHEN rate IS NOT NULL THEN class END) OVER (PARTITION BY source), 3.0::DOUBLE) * uu)) AS copies FROM rb),
pt AS (SELECT c.*, pl.source_size, pl.target, floor(copies) AS sure, copies - floor(copies) AS p
       FROM c JOIN pl ON c.source IS NOT DISTINCT FROM pl.source AND c.class = pl.class),
rk AS (SELECT *, CASE WHEN p > 0 THEN (u * (1 - p)) / (u * (1 - p) + (1 - u) * p) END AS odds FROM pt),
du AS (SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS due,
         coalesce(sum(CASE WHEN odds IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id NULLS LAST, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM rk)
SELECT doc_id, size, source_size, target, source,
       (sure + CASE WHEN odds IS NOT NULL AND sofar < due AND sofar + size / 2 <= due THEN 1 ELSE 0 END)::BIGINT AS times,
       ((sure + CASE WHEN odds IS NOT NULL AND sofar < due AND sofar + size / 2 <= due THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM du
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes."""
    out = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a factorisation machine."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and winner of every document by normalised text."""
    out = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rewritten for filling in its middle, with digests of the output and of the text rebuilt from it."""
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    restored = fim.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit,
    sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM documents),
h AS (SELECT doc_id, text, unit, len(unit)::BIGINT AS n, [('0x' || substr(digest, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
         WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(unit[1:a], '') AS prefix, array_to_string(unit[a + 1:b], '') AS middle, array_to_string(unit[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level vocabulary."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents")).drop("doc_id", "at")


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_spans AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, w, a, k, unnest(range(2, k)) AS m FROM c))),
kept AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(a) AS around FROM inner_spans GROUP BY ALL) USING (lang, phrase)
  WHERE around IS NULL OR around < a),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS one, array_to_string(w[j + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
score AS (SELECT cut.lang, cut.phrase, cut.a, x.a AS l, y.a AS r, n, j, (1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = one JOIN f y ON y.lang = cut.lang AND y.phrase = two JOIN total ON total.lang = cut.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS low FROM score),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM best WHERE low = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


QUERIES = {
    "op1_html_text": (op1_html_text, None),
    "op2_url_filter": (op2_url_filter, OP2_SQL),
    "op3_suffix_array": (op3_suffix_array, None),
    "op4_minhash": (op4_minhash, None),
    "op5_source_mix": (op5_source_mix, OP5_SQL),
    "op6_packing": (op6_packing, None),
    "op7_shards": (op7_shards, None),
    "op8_quality": (op8_quality, None),
    "op9_exact_dedup": (op9_exact_dedup, OP9_SQL),
    "op10_multi_index": (op10_multi_index, None),
    "op11_fill_in_middle": (op11_fill_in_middle, OP11_SQL),
    "op12_token_counts": (op12_token_counts, None),
    "op13_phrases": (op13_phrases, OP13_SQL),
}
