"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import fresh_folder, held_out, table


def vocabulary(name: str) -> str:
    """Where the machine keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lakeloom.llm.byte_bpe import round_trip

    docs = table(spark, sf_dir, "documents")
    return round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.quality import judge

    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm import token_files

    folder = fresh_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder, end_id=0)
    return token_files.read(spark, folder)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=80, count_links=True)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm import licenses

    docs = table(spark, sf_dir, "documents")
    return licenses.per_document(docs, licenses.fit())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm import language_id

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = language_id.fit(docs)
    return language_id.identify(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "cosine", "rejected")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0, room=400_000, chars=12_000_000)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality": op4_quality,
    "op5_token_files": op5_token_files,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_licenses": op7_licenses,
    "op8_language": op8_language,
    "op9_neighbours": op9_neighbours,
    "op10_packing": op10_packing,
}
ORACLES: dict[str, str] = {
    "op4_quality": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(after - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM r) GROUP BY doc_id),
m AS (
  SELECT doc_id, t, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c USING (doc_id)),
k AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    10 * n_symbols > n_words OR 10 * length(regexp_replace(t, '\P{L}+', '', 'g')) < 3 * word_chars
      OR 10 * length(regexp_replace(t, '\P{Lu}+', '', 'g')) > 9 * word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
      OR (len(ls) >= 10 AND 2 * (len(ls) - len(list_distinct(ls))) > len(ls))
      OR 2 * coalesce(list_sum(list_transform(range(2, len(ws) + 1), lambda i: CASE WHEN ws[i] = ws[i - 1] THEN 1 ELSE 0 END)), 0) > n_words AS rejected
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM k
""",
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, sh, len(sh) AS n_shingles, md5(array_to_string(list_sort(sh), chr(10))) AS same FROM s),
c AS (SELECT *, CASE WHEN n_shingles > 0 THEN min(doc_id) OVER (PARTITION BY same) ELSE doc_id END AS class_id FROM n),
r AS (SELECT doc_id, n_shingles, sh FROM c WHERE doc_id = class_id AND n_shingles > 0),
e AS (SELECT doc_id, unnest(sh) AS h FROM r),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN r a ON a.doc_id = x JOIN r b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n_shingles + b.n_shingles - k)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
t AS (SELECT x, y FROM b UNION SELECT t.x, b.y FROM t JOIN b ON b.x = t.y),
m AS (SELECT x, least(x, min(y)) AS component_id FROM t GROUP BY x),
d AS (SELECT x, count(*) AS n_links FROM b GROUP BY x)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, class_id, coalesce(component_id, class_id) AS component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM c LEFT JOIN m ON m.x = class_id LEFT JOIN d ON d.x = class_id
""",
}
