"""Registered queries of the corpus operators, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillcast.llm.alignment import cross_tokenizer_alignment
from fillcast.llm.decontamination import find_contamination
from fillcast.llm.language import held_out as language_held_out
from fillcast.llm.language import identify_languages, train_languages
from fillcast.llm.lines import drop_frequent_lines
from fillcast.llm.mixing import Mixture, select_mixture
from fillcast.llm.prefix_trie import conversation_trie
from fillcast.llm.quality import score_documents
from fillcast.llm.secrets import scan_secrets
from fillcast.llm.sharding import assign_shards
from fillcast.llm.simhash import simhash_components
from fillcast.llm.suffix import remove_repeats
from fillcast.llm.toxicity import held_out, score_toxicity, train_toxicity
from fillcast.llm.urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Domains by source, and weights by level (production parameters of the mixture).
DOMAIN_OF = {"web": ["src0", "src1", "src2", "src3", "src4", "src5"], "books": ["src6", "src7", "src8", "src9"], "code": ["src10", "src11", "src12"]}
MIXTURE = Mixture(
    weights=({"web": 3.0, "books": 2.0, "code": 1.0, "other": 2.0}, {"en": 4.0, "de": 1.0, "fr": 1.0, "es": 1.0}, {"src0": 2.0}),
    share=1.0, max_epochs=2)

#: Vocabulary files of the two tokenizers that are aligned.
BYTE_FILE, PIECE_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of(source: str = "source"):
    out = F.lit("other")
    for domain, sources in DOMAIN_OF.items():
        out = F.when(F.col(source).isin(sources), domain).otherwise(out)
    return out


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep=["doc_id"], bodies=False).drop("removed_spans")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_secrets(docs).select("doc_id", "position", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("n_chars"), "score", "is_secret")


@query
def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "n_bytes", "shard", "shard_depth")


@query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return select_mixture(docs, [domain_of(), F.col("lang"), F.col("source")], MIXTURE).select("doc_id", "lang", "source", "n_tokens", "copies")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer_alignment(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_FILE, PIECE_FILE)


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_languages(docs, train_languages(docs), keep=["doc_id"])
    return found.select("doc_id", language_held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


SQL["op10_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, frequent.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent ON keyed.k = frequent.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

# crc32 of a decimal: eight shifts for each byte, with the reflected polynomial.
SQL["op13_conversation_trie"] = r"""
WITH RECURSIVE own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc(conv_id, rest, c, k) AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR), 4294967295::BIGINT, 0 FROM own
  UNION ALL
  SELECT conv_id, CASE WHEN k = 8 THEN rest[2:] ELSE rest END,
         CASE WHEN k = 0 THEN xor(c, ord(rest)::BIGINT) ELSE xor(c >> 1, (c & 1) * 3988292384) END,
         CASE WHEN k = 8 THEN 0 ELSE k + 1 END
  FROM crc WHERE rest <> ''),
heads AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM crc WHERE rest = ''),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.s[1:h], []), o.s[h + 1:]) AS s
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
starts AS (
  SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ends
  FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM starts GROUP BY p),
children AS (SELECT p[1:depth - 1] AS above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sized AS (
  SELECT nodes.*, CASE WHEN depth > 0 THEN p[1:depth - 1] END AS up, coalesce(children.n, 0) AS n_children,
         CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(p[depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own_tokens
  FROM nodes LEFT JOIN children ON children.above = nodes.p),
subtree AS (
  SELECT p[1:k] AS p, count_if(n_children = 0) AS n_leaves, sum(own_tokens) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM sized) GROUP BY 1)
SELECT s.conv_id, s.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, s.n_convs::BIGINT AS n_convs, s.n_children::BIGINT AS n_children,
       t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, s.ends_sha256
FROM sized s JOIN subtree t ON s.p = t.p LEFT JOIN nodes u ON s.up = u.p"""
