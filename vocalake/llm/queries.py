"""One query per operator over its whole table, with the SQL that gives the same rows where SQL can."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, quality, toxicity
from .common import fold_of, table
from .exact_dedup import exact_groups
from .fill_middle import fill_middle, restore
from .filter_audit import audit_filters
from .line_dedup import dedup_lines
from .near_dedup import near_components
from .packing import pack, token_pieces
from .secrets import BASE_KINDS, find_secrets, of_kinds, span_list
from .tokens import line_token_counts
from .topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_bpe")
def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(spark, F.col("ids")), 256).alias("decoded_sha256"),
    )


@query("op2_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


@query("op3_toxicity")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, field).select(
        F.col("id").alias("doc_id"), (fold_of(F.col("id")) == 1).alias("held_out"), "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("toxic_spans"),
    )


@query("op4_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(of_kinds(F.col("spans"), (kind,))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        F.col("id").alias("doc_id"), *counts,
        F.sha2(span_list(of_kinds(F.col("spans"), BASE_KINDS)), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


@query("op5_exact_topk", """
WITH vectors AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
""")
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5).withColumnRenamed("id", "vec_id")


@query("op6_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op7_exact_dedup", """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
  FROM documents
), groups AS (
  SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY content
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(content) AS text_sha256
FROM rows JOIN groups USING (content)
""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).withColumnsRenamed({"id": "doc_id", "digest": "text_sha256"})


@query("op8_near_dedup", """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m ON s.doc_id = m.doc_id
""")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op9_line_dedup", """
WITH docs AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM docs
), windows AS (
  SELECT doc_id, pos, concat(line, chr(10), lead(line) OVER w, chr(10), lead(line, 2) OVER w) AS passage,
         lead(line, 2) OVER w IS NOT NULL AS whole
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), filled AS (
  SELECT doc_id, pos, passage FROM windows
  WHERE whole AND length(trim(passage, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) > 0
), firsts AS (
  SELECT passage, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM filled
  GROUP BY passage HAVING count(*) > 1
), later AS (
  SELECT f.doc_id, CASE WHEN f.doc_id = r.first.doc_id THEN greatest(f.pos, r.first.pos + 3) ELSE f.pos END AS lo,
         f.pos + 2 AS hi
  FROM filled f JOIN firsts r USING (passage)
  WHERE NOT (f.doc_id = r.first.doc_id AND f.pos = r.first.pos)
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(lo, hi)) AS pos FROM later WHERE lo <= hi
), kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.pos) AS text
  FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id
), counts AS (
  SELECT doc_id, count(*)::INT AS n_removed FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(d.lines)::INT END AS n_lines,
       coalesce(c.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM docs d LEFT JOIN counts c ON d.doc_id = c.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify_languages(docs, language.train_on(docs)).select(
        F.col("id").alias("doc_id"), (fold_of(F.col("id")) == 1).alias("held_out"), "lang_pred", "score",
        F.array_join(
            F.transform("spans", lambda s: F.concat_ws(":", s["lang"], s["start"], s["end"])), ","
        ).alias("lang_spans"),
    )


@query("op11_quality_rules", r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         [l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines
  FROM docs
), placed AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split
), windows AS (
  SELECT r, pos, word, lead(word) OVER w AS second, lead(word, 2) OVER w AS third
  FROM placed WINDOW w AS (PARTITION BY r ORDER BY pos)
), repeated AS (
  SELECT r, pos, count(*) OVER (PARTITION BY r, word, second, third) AS n FROM windows WHERE third IS NOT NULL
), covered AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS place FROM repeated WHERE n > 1)
  GROUP BY r
), measured AS (
  SELECT s.r, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len([w FOR w IN words IF regexp_matches(w, '\pL')])::BIGINT AS n_letter_words,
         len([w FOR w IN words IF regexp_full_match(
           translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{STOP}')])::BIGINT AS n_stop_words,
         len([l FOR l IN lines IF regexp_matches(l, '^[\x20\x09-\x0D]*[•‣▪*-]')])::BIGINT AS n_bullet_lines,
         len([l FOR l IN lines IF regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$')])::BIGINT AS n_ellipsis_lines
  FROM split s LEFT JOIN covered c ON s.r = c.r
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words AND 100 * n_symbols <= 10 * n_words
       AND 100 * n_letter_words >= 80 * n_words AND 100 * n_stop_words >= 2 * n_words
       AND 100 * n_dup_lines <= 35 * n_lines AND 100 * n_bullet_lines <= 90 * n_lines
       AND 100 * n_ellipsis_lines <= 30 * n_lines AS kept
FROM judged
""".replace("{STOP}", "[{0}]*({1})[{0}]*".format(quality.MARKS, "|".join(quality.STOP_WORDS.split()))))
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query("op12_fill_middle", r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n,
         [('0x' || substr(digest, 1 + 8 * i, 8))::BIGINT FOR i IN range(4)] AS h
  FROM units
), formed AS (
  SELECT *, CASE
    WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50
      THEN 'plain'
    WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b
  FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(units[:a], ''), '') AS prefix,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'spm' THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle)
              WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
""")
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op13_filter_audit", r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 50)::INT AS a, (100 * len(list_distinct(words)) < 65 * len(words))::INT AS b,
         (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT AS c,
         regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(d.doc_id > first_id, false)::INT AS e
  FROM docs d LEFT JOIN marks m ON d.doc_id = m.doc_id
), counted AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failing GROUP BY ALL
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(letter, bit)
), orders AS (
  SELECT concat(v.letter, w.letter, x.letter, y.letter, z.letter) AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM letters v, letters w, letters x, letters y, letters z WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31
), steps AS (
  SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[:s - 1]), 0)::INT AS before
  FROM orders, range(1, 6) AS r(s)
), walked AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit
)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM walked
""")
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
