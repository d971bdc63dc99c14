"""The queries of this subpackage over the documents, embeddings, pages and conversations tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat_format, embedding_dedup, html_extract, jaccard_join, license_scan, lm_scoring, packing, quality_rules, source_mix, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that the labels call good and not toxic."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixed_sizes(table(spark, sf_dir, "documents")).drop("source", "shards")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=49407)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts hold control strings."""
    hostile = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.format_conversations(turns, public_tokenizers.path("byte_bpe_50k.json"))).drop("n_tokens")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_lm_scoring, op3_source_mix, op4_quality_rules, op5_token_counts,
        op6_packing, op7_chat_format, op8_embedding_dedup, op9_jaccard_join, op10_html_extract,
    )
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op4_quality_rules": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, source, text, [y for y in regexp_split_to_array(text, '[ \t-\r]+') if y <> ''] AS w, [y for y in string_split(text, chr(10)) if regexp_matches(y, '[^ \t-\r]')] AS l FROM docs),
windows AS (SELECT r, i, w[i : i + 4] AS g FROM split, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY r),
counts AS (SELECT s.r, doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[ \t-\r]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, CASE WHEN len(w) > 0 THEN lower(array_to_string(w, ' ')) END AS whole FROM split s LEFT JOIN covered c ON c.r = s.r),
lines AS (SELECT r, lower(array_to_string([y for y in regexp_split_to_array(x, '[ \t-\r]+') if y <> ''], ' ')) AS line, len([y for y in regexp_split_to_array(x, '[ \t-\r]+') if y <> '']) AS n FROM (SELECT r, unnest(l) AS x FROM split)),
hosts AS (SELECT source, count(DISTINCT whole) AS of FROM counts GROUP BY source),
often AS (SELECT c.source, line, count(DISTINCT whole) AS c FROM lines JOIN counts c USING (r) GROUP BY ALL HAVING count(DISTINCT whole) > 30),
gone AS (SELECT o.source, line FROM often o JOIN hosts h ON h.source IS NOT DISTINCT FROM o.source WHERE o.c > 0.02 * h.of),
lost AS (SELECT l.r, sum(l.n) AS n FROM lines l JOIN counts c USING (r) JOIN gone g ON g.line = l.line AND g.source IS NOT DISTINCT FROM c.source GROUP BY l.r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(lost.n, 0)::BIGINT AS lost_words,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (coalesce(lost.n, 0) > 0.8 * n_words OR (2 * coalesce(lost.n, 0) > n_words AND n_words - coalesce(lost.n, 0) < 10)) AS kept
FROM counts c LEFT JOIN lost ON lost.r = c.r""",
    "op3_source_mix": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '~' || md5(coalesce(text, ''))) AS key, source, len([y for y in regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+') if y <> ''])::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) AS slot FROM docs GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(slot - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM per),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
level AS (SELECT arg_min(level, (cap / weight, slot)) AS level FROM levels WHERE weight * level <= cap),
total AS (SELECT sum(size) AS total FROM docs),
targets AS (SELECT w.source, slot, source_size, least(cap, weight * l.level) AS target,
  greatest(1, least(n_docs, round(source_size / greatest(1, least(4194304, total // 1024)))))::BIGINT AS n_blocks FROM weighed w, level l, total),
dealt AS (SELECT d.*, t.slot, t.source_size, t.target, ('0x' || substr(md5(concat_ws(':', '7:block', key)), 1, 8))::BIGINT % n_blocks AS block FROM docs d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source),
blocks AS (SELECT slot, block, sum(size)::BIGINT AS words, any_value(source_size) AS source_size, round(any_value(target))::BIGINT AS due FROM dealt GROUP BY slot, block HAVING sum(size) > 0),
drawn AS (SELECT slot, block, pass, words, greatest(0, least(words, greatest(0, least(source_size, due - pass * source_size))
  - coalesce(sum(words) OVER (PARTITION BY slot, pass ORDER BY ('0x' || substr(md5(concat_ws(':', '7:permute', pass, slot, block)), 1, 8))::BIGINT, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take
  FROM blocks, (SELECT unnest([0, 1]) AS pass)),
placed AS (SELECT d.r, d.doc_id, d.size, d.source_size, d.target, x.pass, x.words, x.take,
  coalesce(sum(d.size) OVER (PARTITION BY d.slot, d.block, x.pass ORDER BY ('0x' || substr(md5(concat_ws(':', '7:cut', d.key)), 1, 8))::BIGINT, d.key, d.size, d.r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM dealt d LEFT JOIN drawn x ON x.slot = d.slot AND x.block = d.block)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target)::DOUBLE AS target, sum(greatest(0, least(size, coalesce(take, 0) - before)))::BIGINT AS taken FROM placed GROUP BY r, doc_id""",
    "op7_chat_format": r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
c AS (SELECT '(<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<\|startoftext\|>|</?s>|<unk>|<pad>|\[/?INST\]|<</?SYS>>)' AS control),
long AS (SELECT *, 10 + 12 + 10 + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, control)) AS shown FROM turns, c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown)::BIGINT AS formatted_chars FROM long GROUP BY conv_id""",
    "op8_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9 * a.n * b.n),
reach(id, least) USING KEY (id) AS (SELECT vec_id, vec_id FROM v UNION
  SELECT l.b, min(r.least) FROM reach r JOIN links l ON l.a = r.id JOIN recurring.reach k ON k.id = l.b WHERE r.least < k.least GROUP BY l.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n.n, 0) AS n_links, least AS component_id, id = least AS kept FROM reach LEFT JOIN n ON n.a = id""",
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, [y for y in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+') if y <> ''] AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 1))) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(id, least) USING KEY (id) AS (SELECT doc_id, doc_id FROM w UNION
  SELECT l.b, min(r.least) FROM reach r JOIN links l ON l.a = r.id JOIN recurring.reach k ON k.id = l.b WHERE r.least < k.least GROUP BY l.b)
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, least AS component_id FROM reach LEFT JOIN sizes ON sizes.doc_id = id""",
    # pages of the test tables have one article of paragraphs each
    "op10_html_extract": r"""
WITH raw AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?p>|</?h1>') AS b FROM pages),
plain AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(y, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&(lt|gt);', '', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) for y in b] AS b FROM raw)
SELECT page_id, url, array_to_string([y for y in b if y <> ''], chr(10)) AS text, length(array_to_string([y for y in b if y <> ''], chr(10)))::BIGINT AS n_chars FROM plain""",
}
