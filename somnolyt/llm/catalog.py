"""Queries of this package, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, cnn, collocations, exact, langid, mtree, packing, rules, sampling, simhash, substring, toxicity
from .textkit import documents, id_bucket

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_chat_format", sql=r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|IMAGE\]|AUDIO\]|DOCUMENT\])', '\1\\\2\3', 'g') AS body,
         regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|IMAGE\]|AUDIO\]|DOCUMENT\])', '\1\\\2\3', 'g') AS named
  FROM m),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (WHERE role = 'assistant'), '') AS loss,
    3 + sum(length('[INST]' || named || '[/INST]' || body || '</s>')) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM g
""")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back from the output."""
    said = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    messages = rows.unionByName(planted).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.conversation_digests(chat.format_conversations(messages))


_RULES_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, text,
         list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d),
win AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS s
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT rid, s FROM win GROUP BY rid, s HAVING count(*) >= 2),
covered AS (
  SELECT rid, count(DISTINCT i + j) AS n
  FROM (SELECT win.rid, win.i, unnest(range(0, 8)) AS j FROM win JOIN twice USING (rid, s)) GROUP BY rid),
c AS (
  SELECT w.rid, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
         len(list_filter(words, lambda x: regexp_matches(x, '^[A-Z]{{2,}}')))::BIGINT AS n_upper_words
  FROM w LEFT JOIN covered ON covered.rid = w.rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_upper_words,
       base_failed, NOT base_failed AND {verdict} AS kept
FROM b
"""


def _rules_sql() -> str:
    metric = {"mean_word_chars": "word_chars / greatest(n_words, 1)", "symbols_per_word": "n_symbols / greatest(n_words, 1)",
              "stop_word_share": "n_stop_words / greatest(n_words, 1)", "upper_share": "n_upper_words / greatest(n_words, 1)",
              "dup_line_share": "n_dup_lines / greatest(n_lines, 1)"}
    tests = [f"{metric[r.metric]} {op} {bound}::DOUBLE" for r in rules.RULES
             for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return _RULES_SQL.format(stop=", ".join(f"'{w}'" for w in rules.STOP_WORDS), verdict=" AND ".join(tests))


@query("op10_quality_rules", sql=_rules_sql())
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    return rules.quality_rules(documents(spark, sf_dir))


@query("op2_substring_dedup", sql="""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
           FROM documents),
win AS (SELECT rid, i, sha256(array_to_string(words[i:i + 34], ' ')) AS s
        FROM (SELECT rid, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) >= 2),
gone AS (SELECT DISTINCT rid, i + j AS at
         FROM (SELECT rid, i, unnest(range(0, 35)) AS j FROM win SEMI JOIN twice USING (s))),
kept AS (SELECT w.rid, string_agg(w.word, ' ' ORDER BY w.at) AS text, count(*) AS n
         FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM d) w
         ANTI JOIN gone ON gone.rid = w.rid AND gone.at = w.at GROUP BY w.rid)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.rid = d.rid
""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated windows."""
    found = substring.substring_dedup(documents(spark, sf_dir), ["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-copy component."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """The model of op4, learned from training rows only."""
    return toxicity.train(sampling.labelled_sample(
        docs, labels(spark, sf_dir), "toxic", 5, 0, rows=toxicity.TRAINING_ROWS))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = documents(spark, sf_dir)
    return toxicity.verdicts(toxicity.score_documents(docs, toxicity_model(spark, docs, sf_dir)), 5, 0)


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and its ids decoded."""
    return bpe.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN)


@query("op6_exact_dedup", sql="""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(length(text), 0) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST, rid)
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays."""
    return exact.exact_dedup(documents(spark, sf_dir))


@query("op7_quality_cnn")
def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = documents(spark, sf_dir)
    sample = sampling.labelled_sample(docs, labels(spark, sf_dir), "quality", 3, 1, rows=cnn.TRAINING_ROWS)
    return cnn.verdicts(cnn.score_documents(docs, cnn.train(sample)), 3, 1)


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs, path = documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = langid.identify(docs, langid.learn(docs, path, 5, 0), path)
    return found.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences along the curve."""
    return packed_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def packed_pieces(docs: DataFrame, path: str) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return packing.pack(docs, path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of two tokenizers, with corpus-wide pair counts."""
    return align.alignment_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                   public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_mtree_topk", sql="""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.x, c.x, true), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op12_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best other vectors for each vector whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mtree.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


@query("op13_collocations", sql=r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, lang, words FROM (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents)) WHERE len(words) > 0),
g AS (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM p, (SELECT unnest(range(1, 5)) AS size) WHERE len(words) >= size)),
t AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, ((2000000 * k.a::HUGEINT) // (x.f + y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ')
         JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS j
        FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2)) GROUP BY ALL),
o AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000
""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 2000 collocations of each language."""
    return collocations.collocations(documents(spark, sf_dir))
