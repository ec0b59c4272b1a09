"""The queries over the numbered operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_trie, fill_middle, language_id, license_scan, mixing, near_dedup, phrases, quality_rules, sharding, token_counts, token_files, url_filters, vector_topk
from tidemark.llm.cluster import new_folder
from tidemark.llm.vocabulary import default_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(documents(spark, sf_dir))


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).drop("uid")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), path, default_path("word_bpe_49k.json"), end_id=2)
    return token_files.digests(token_files.read_token_files(spark, path))


def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.rate(documents(spark, sf_dir))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), default_path("word_bpe_49k.json"))


def op9_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.recode_digests(documents(spark, sf_dir), default_path("byte_bpe_50k.json"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filters.judge(pages, url_filters.fit(url_filters.labelled_by(pages)))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(documents(spark, sf_dir)))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_language_filters": op2_language_filters,
    "op3_license_scan": op3_license_scan,
    "op4_line_quality": op4_line_quality,
    "op5_exact_topk": op5_exact_topk,
    "op6_token_counts": op6_token_counts,
    "op9_trie_bpe": op9_trie_bpe,
    "op7_interleaved_shards": op7_interleaved_shards,
    "op8_systematic_mix": op8_systematic_mix,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_url_filters": op11_url_filters,
    "op12_phrases": op12_phrases,
    "op13_fill_middle": op13_fill_middle,
}

_POSTINGS = ", ".join(f"('{w}', {t}, {i})" for w, t, i in license_scan._postings())
_KEYS = ", ".join(
    f"({t}, '{label}', {license_scan._key_places(text, keys)}, {sum(1 for _, k, _ in license_scan._postings() if k == t)})" for t, (label, text, keys) in enumerate(license_scan.TEMPLATES)
)

#: Seeded keys as the operators make them: 60 bits of an MD5.
_KEY = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"

SQL: dict[str, str] = {
    "op7_interleaved_shards": f"""
WITH RECURSIVE crc_bits AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8),
d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
),
k AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS s, strlen(text) + 8 AS size,
         xor(list_reduce(list_prepend(4294967295, [CAST(('0x' || x) AS BIGINT) FOR x IN regexp_extract_all(hex(encode(text)), '..')]),
             lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32,
         {_KEY.format("concat_ws('|', 'shards-1', doc_id, md5(text))")} AS key
  FROM d, crc_table
),
f AS (
  SELECT *, (row_number() OVER (PARTITION BY s ORDER BY key, doc_id)
             - {_KEY.format("concat_ws('|', 'shards-1', 'source', s)")}::DOUBLE / 1152921504606846976.0) / count(*) OVER (PARTITION BY s) AS frac
  FROM k
),
p AS (SELECT *, row_number() OVER (ORDER BY frac, key, doc_id) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(pos * 24 // n AS INTEGER) AS shard,
       CAST(pos - ((pos * 24 // n) * n + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
""",
    "op8_systematic_mix": f"""
WITH k AS (
  SELECT doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0) AS size,
         {_KEY.format("concat_ws('|', 'mixture-1', doc_id, md5(coalesce(text, '')))")} AS key
  FROM documents
),
c AS (SELECT *, CASE WHEN size < 64 THEN size ELSE 1000 + 100 * length(size::VARCHAR) + substr(size::VARCHAR, 1, 2)::BIGINT END AS class FROM k),
per AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS i FROM c GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][i % 3 + 1]::DOUBLE AS w, 2.0 * source_size AS cap FROM per),
l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
),
best AS (SELECT arg_min(level, (cap / w, i)) AS level FROM l WHERE level * w <= cap),
t AS (
  SELECT l.source, source_size, least(cap, coalesce(best.level * w, cap)) AS target,
         floor({_KEY.format("concat_ws('|', 'mixture-1', 'offset', CASE WHEN l.source IS NULL THEN 'null' ELSE '=' || l.source END)")}::DOUBLE / 1152921504606846976.0 * 16777216)::BIGINT AS off
  FROM l, best
),
s AS (
  SELECT c.*, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN floor(target / source_size * 16777216)::BIGINT ELSE 0 END AS e
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, key, doc_id) * e + off AS upto FROM s)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, CAST(((upto >> 24) - ((upto - e) >> 24)) * size AS BIGINT) AS taken
FROM r
""",
    "op10_near_duplicates": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FOR i IN range(1, len(w) - 3)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w
),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
r AS (
  SELECT doc_id, doc_id AS reach FROM documents
  UNION
  SELECT r.doc_id, p.v FROM r JOIN p ON r.reach = p.u
),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON s.doc_id = c.doc_id
""",
    "op3_license_scan": f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents
),
p(w, t, place) AS (VALUES {_POSTINGS}),
k(t, label, keys, n) AS (VALUES {_KEYS}),
words AS (SELECT doc_id, w[i + 1] AS w, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w) WHERE w[i + 1] IN (SELECT w FROM p)),
votes AS (
  SELECT doc_id, p.t, i - place AS shift, list(DISTINCT place) AS places
  FROM words JOIN p ON words.w = p.w GROUP BY doc_id, p.t, i - place
),
found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(len(places) / n::DOUBLE) AS score
  FROM votes JOIN k ON votes.t = k.t WHERE list_has_all(places, keys) GROUP BY doc_id
),
b AS (
  SELECT doc_id, w, [i FOR i IN range(len(w)) IF w[i + 1] = 'cc' AND w[i + 2] = 'by'] AS c, [i FOR i IN range(len(w)) IF w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license'] AS g,
         [i FOR i IN range(len(w)) IF w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved'] AS a
  FROM w
),
l AS (
  SELECT *, list_concat(list_concat(c, g), a) AS every,
         list_filter([CASE WHEN len(c) > 0 THEN 'cc-by' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(a) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base
  FROM b
)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word, CAST(list_max(every) AS BIGINT) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM l LEFT JOIN found ON l.doc_id = found.doc_id
""",
    "op4_line_quality": """
WITH d AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
),
win AS (
  SELECT doc_id, i, [w[k] FOR k IN range(i, i + 8)] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
rw AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM rep WHERE n > 1) GROUP BY doc_id),
b AS (
  SELECT d.doc_id, host, text, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words, ls
  FROM d LEFT JOIN rw ON d.doc_id = rw.doc_id
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
l AS (SELECT doc_id, host, text, trim(regexp_replace(lower(unnest(ls)), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line FROM f),
hosts AS (SELECT host, count(DISTINCT text) AS of FROM f GROUP BY host),
common AS (
  SELECT l.host, line FROM l JOIN hosts ON l.host = hosts.host GROUP BY l.host, line, of
  HAVING count(DISTINCT text) > 10 AND count(DISTINCT text) > least(0.02 * of, 10000)
),
gone AS (
  SELECT l.doc_id, sum(len(string_split(l.line, ' '))) AS n FROM l JOIN common c ON l.host = c.host AND l.line = c.line GROUP BY l.doc_id
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 - coalesce(gone.n, 0)::DOUBLE / greatest(n_words, 1) >= 0.2 AS kept
FROM f LEFT JOIN gone ON f.doc_id = gone.doc_id
""",
    "op5_exact_topk": """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op12_phrases": f"""
WITH p AS MATERIALIZED (
  SELECT lang, row_number() OVER () AS piece, w FROM (
    SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')), '[\\x20\\x09]+'), lambda x: x <> '') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
  )
),
u AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM p),
o AS MATERIALIZED (SELECT lang, w1, lead(w1) OVER x AS w2, lead(w1, 2) OVER x AS w3 FROM u WINDOW x AS (PARTITION BY piece ORDER BY i)),
words AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, w1 AS phrase, count(*) AS f FROM o GROUP BY ALL
  UNION ALL
  SELECT lang, w1 || ' ' || w2, count(*) FROM o WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT lang, w1 || ' ' || w2 || ' ' || w3, count(*) FROM o WHERE w3 IS NOT NULL GROUP BY ALL
),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE f >= {phrases.LEAST} AND contains(phrase, ' ')),
cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS first_, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c)),
half AS MATERIALIZED (SELECT cuts.*, x.f AS l FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first_),
s AS (
  SELECT half.lang, half.phrase, w, a, k, l, y.f AS r, CAST({phrases.SCALE}::HUGEINT * a * a // (l::HUGEINT * y.f) AS BIGINT) AS score
  FROM half JOIN f y ON y.lang = half.lang AND y.phrase = rest
),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM s) WHERE i = 1),
inner_ AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE len(w) = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE len(w) = 3
  ) GROUP BY ALL
),
r AS (
  SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
  FROM low LEFT JOIN inner_ ON low.lang = inner_.lang AND low.phrase = inner_.phrase WHERE most IS NULL OR 100 * most < {phrases.COVERED} * a
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN words ON r.lang = words.lang WHERE rank <= {phrases.TOP}
""",
    "op13_fill_middle": """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
),
h AS (SELECT *, len(w) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS d FROM t),
c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b FROM h),
f AS (
  SELECT doc_id, n, text, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m, coalesce(array_to_string(w[b + 1:], ''), '') AS s
  FROM c
),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM f),
b AS (SELECT *, string_split_regex(output, '<[PSM]>') AS x FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256
FROM b
""",
}
