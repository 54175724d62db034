"""The registered queries opN_<name> and their SQL: thin uses of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, language, lines, media, mixing, neardup, packing, phrases, quality, substrings, toxicity, trie, urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.sound_digests(media.sniff_media(media.store_texts(_read(spark, sf_dir, "documents"))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.5)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_read(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_read(spark, sf_dir, "documents"), length=400, passage_words=51)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mixing.replicate(docs, mixing.rates(docs, exponent=0.5), seed=17)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_windows(_read(spark, sf_dir, "documents"), size=3).select("doc_id", "text", "n_lines", "n_removed")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3)


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), *_vocabulary(), end_id=0, capacity=2048)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"))


#: The rules that the query judges by (fixed values).
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages"), URL_RULES, rounds=12, percent=50)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"), least=10, percent=50, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media_columns, op2_toxicity, op3_fingerprints, op4_language, op5_suffix_dedup, op6_mix_sources, op7_line_dedup, op8_quality, op9_pack, op10_near_duplicates, op11_prefix_trie, op12_url_filter, op13_collocations)}

ORACLES: dict[str, str] = {}

ORACLES["op10_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)
), sizes AS (
  SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s USING (doc_id) GROUP BY ALL
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT s.doc_id, s.n AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.n
"""

ORACLES["op6_mix_sources"] = r"""
WITH RECURSIVE counts AS (
  SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY ALL
), rate AS (
  SELECT src, n, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts
), pieces AS (
  SELECT src, greatest(ceil(rate / 64), 1)::INT AS m, rate / greatest(ceil(rate / 64), 1) AS mean FROM rate
), cdf AS (
  SELECT src, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM pieces
  UNION ALL SELECT src, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 20)
), tables AS (
  SELECT src, list(c ORDER BY k) AS cs FROM cdf GROUP BY src
), draws AS (
  SELECT d.*, t.cs, unnest(range(0, p.m)) AS i FROM documents d JOIN pieces p ON p.src = coalesce(d.source, '') JOIN tables t ON t.src = p.src
), counted AS (
  SELECT doc_id, text, lang, source, n_chars,
    sum(len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('17:' || doc_id || ':' || i), 1, 13))::BIGINT / 4503599627370496.0)))::INT AS copies
  FROM draws GROUP BY ALL
), spread AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INT AS copy FROM counted
)
SELECT *, md5('17:order:' || doc_id || ':' || copy) AS shuffle_key FROM spread
"""

ORACLES["op7_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, text, md5(coalesce(text, '')) AS copy, string_split(text, chr(10)) AS ls FROM documents
), windows AS (
  SELECT doc_id, copy, pos, array_to_string(ls[pos + 1:pos + 3], chr(10)) AS w
  FROM (SELECT doc_id, copy, ls, unnest(range(0, len(ls) - 2)) AS pos FROM split WHERE len(ls) >= 3)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, copy, pos) AS rn FROM windows WHERE regexp_matches(w, '\S')
), covered AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM ranked WHERE rn > 1
), numbered AS (
  SELECT doc_id, unnest(ls) AS l, unnest(range(0, len(ls))) AS line FROM split
), kept AS (
  SELECT n.doc_id, string_agg(n.l, chr(10) ORDER BY n.line) AS body, count(*) AS n FROM numbered n ANTI JOIN covered c ON c.doc_id = n.doc_id AND c.line = n.line GROUP BY n.doc_id
)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.body, '') END AS text, coalesce(len(s.ls), 0)::INT AS n_lines, (coalesce(len(s.ls), 0) - coalesce(k.n, 0))::INT AS n_removed
FROM split s LEFT JOIN kept k USING (doc_id)
"""

ORACLES["op11_prefix_trie"] = r"""
WITH sorted AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), shared AS (
  SELECT conv_id, ts, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h FROM sorted
), built AS (
  SELECT s.conv_id, list_concat(coalesce(b.ts, [])[1:s.h], s.ts[s.h + 1:]) AS ts FROM shared s LEFT JOIN sorted b ON b.conv_id = s.conv_id - s.conv_id % 100
), prefixes AS (
  SELECT conv_id, len(ts) AS deep, d, ts[1:d] AS p FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM built)
), nodes AS (
  SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE deep = d), '')) AS ends_sha256,
    CASE WHEN any_value(d) = 0 THEN 0 ELSE (count(*) - 1) * length(any_value(p[d].text)) END AS own FROM prefixes GROUP BY p
), kids AS (
  SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), above AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, unnest(range(0, n.depth + 1)) AS up FROM nodes n LEFT JOIN kids k ON k.p = n.p
), sums AS (
  SELECT p[1:up] AS p, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved_tokens FROM above GROUP BY 1
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.p = n.p LEFT JOIN kids k ON k.p = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.p[1:n.depth - 1]
"""

ORACLES["op12_url_filter"] = r"""
WITH RECURSIVE rules(rule, verdict, rule_host, rule_path) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), ruled AS (
  SELECT p.page_id, p.host, p.path, p.html, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path) GROUP BY ALL
), named AS (
  SELECT page_id, host, list_distinct(list_transform(regexp_extract_all(html, '[A-Za-z0-9_-]*\.[A-Za-z0-9_.-]*'), lambda x: translate(trim(x, '.'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS names FROM parts WHERE host <> ''
), links AS (
  SELECT host AS src, dst, count(*) AS n FROM (SELECT host, unnest(names) AS dst FROM named) WHERE host <> dst AND dst IN (SELECT host FROM parts WHERE host <> '') GROUP BY ALL
), ways AS (
  SELECT *, sum(n) OVER (PARTITION BY kind, src) AS total FROM (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links)
), seeds AS (
  SELECT kind, host, (n::HUGEINT * 1000000000000000 // sum(n) OVER (PARTITION BY kind)::HUGEINT)::BIGINT AS units
  FROM (SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM ruled WHERE verdict IS NOT NULL GROUP BY ALL)
), walk AS (
  SELECT 0 AS step, kind, host, units FROM seeds WHERE units > 0
  UNION ALL
  SELECT * FROM (SELECT any_value(w.step) + 1 AS step, w.kind, e.dst AS host, sum(w.units::HUGEINT * e.n * 85 // (e.total::HUGEINT * 100))::BIGINT AS units
    FROM walk w JOIN ways e ON e.kind = w.kind AND e.src = w.host WHERE w.step < 12 GROUP BY w.kind, e.dst) WHERE units > 0
), scores AS (
  SELECT host, sum(CASE WHEN kind = 'trust' THEN units ELSE 0 END)::BIGINT AS trust, sum(CASE WHEN kind = 'distrust' THEN units ELSE 0 END)::BIGINT AS distrust FROM walk GROUP BY host
)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.verdict, CASE WHEN s.distrust > s.trust THEN 'block' ELSE 'allow' END) AS verdict, coalesce(s.trust, 0) AS trust, coalesce(s.distrust, 0) AS distrust
FROM ruled r LEFT JOIN scores s USING (host)
"""

ORACLES["op13_collocations"] = r"""
WITH pieces AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), one AS MATERIALIZED (
  SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM pieces) GROUP BY ALL
), two AS MATERIALIZED (
  SELECT lang, t.x, t.y, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {'x': w[i], 'y': w[i + 1]})) AS t FROM pieces) GROUP BY ALL HAVING count(*) >= 10
), three AS MATERIALIZED (
  SELECT lang, t.x, t.y, t.z, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {'x': w[i], 'y': w[i + 1], 'z': w[i + 2]})) AS t FROM pieces) GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL
), cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r FROM two t LEFT JOIN longer o ON o.lang = t.lang AND o.x = t.x AND o.y = t.y
    JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y WHERE o.f IS NULL OR 100 * o.f < 50 * t.f
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, q.f FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, q.f FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), weakest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored) WHERE place = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest
)
SELECT lang, rank, phrase, a, l, r, (SELECT sum(f) FROM one o WHERE o.lang = ranked.lang)::BIGINT AS n, score FROM ranked WHERE rank <= 2000
"""
