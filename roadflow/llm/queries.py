"""The registered queries of the operators, each over its whole table, and SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, chat, decontaminate, divergence, hmm, kdtree, licenses, neardup, quality, repair, ring, tokencounts, toxicity
from .text import held_out, prepared, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepared(spark), folder)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Fixed value: the text of both turns of conversation -1.
EXTRA_TURN = "</s>[INST] ok [/INST]"


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_license_scan", licenses.report_sql())
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices in every text."""
    return licenses.report(licenses.scan(table(spark, folder, "documents")))


@register("op2_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by averaged subword embeddings."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(spark, folder, docs)
    return toxicity.report(toxicity.score(docs, model), held_out(F.col("doc_id"), 3))


# Two sets that are linked share a shingle among the rarest fifth of each, and one: the others are compared in whole.
NEAR_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
each AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
ranked AS MATERIALIZED (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS k
    FROM each JOIN (SELECT x, count(*) AS f FROM each GROUP BY x) USING (x)),
head AS MATERIALIZED (SELECT * FROM ranked WHERE k <= n - (4 * n + 4) // 5 + 1),
near AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM head a JOIN head b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
links AS MATERIALIZED (SELECT a, b FROM (SELECT near.a, near.b, len(list_intersect(p.s, q.s)) AS both_, len(p.s) + len(q.s) AS sum_
    FROM near JOIN sets p ON p.doc_id = near.a JOIN sets q ON q.doc_id = near.b) WHERE 100 * both_ >= 80 * (sum_ - both_)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM sets UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.doc_id WHERE reach.root < ways.b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


@register("op3_near_duplicates", NEAR_SQL)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents that share four in five of their four-word shingles."""
    return neardup.groups(table(spark, folder, "documents"), words=4).drop("key")


DECONTAMINATION_SQL = r"""
WITH item AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
found AS (
  SELECT r, i, n, item_id FROM (
    SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS win
    FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)) JOIN win USING (n, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
ids AS (SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
  FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(ids.n, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""


@register("op4_language_model")
def language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every text under a hidden Markov model of four in five of them."""
    return hmm.score(table(spark, folder, "documents"))


@register("op5_benchmark_decontamination", DECONTAMINATION_SQL)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside ten-word windows of the benchmark."""
    return decontaminate.report(decontaminate.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@register("op8_chat_format", chat.report_sql(EXTRA_TURN))
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", EXTRA_TURN), (-1, 1, "assistant", EXTRA_TURN)], turns.schema)
    return chat.report(chat.format_chats(turns.union(extra)))


@register("op10_shards")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen shards of the documents with row counts at most one apart."""
    return ring.shard_documents(table(spark, folder, "documents"))


@register("op6_bpe")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as tokens of a byte-level vocabulary and back."""
    path = vocabulary_file()
    return bpe.report(bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), path))


TOP_K_SQL = """
WITH v AS (SELECT row_number() OVER () AS i, vec_id, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT i, vec_id, len(e) AS n, list_transform(e, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS p FROM v),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.p, c.p) AS BIGINT) AS score
  FROM p q JOIN p c ON q.n = c.n AND q.i <> c.i WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@register("op7_exact_top_k", TOP_K_SQL)
def exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    return kdtree.top_k(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


@register("op9_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by an additive model with interactions."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(spark, folder, docs)
    return quality.report(quality.score(docs, model), held_out(F.col("doc_id"), 3))


@register("op11_conversation_repair")
def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and the hash of what that leaves."""
    return repair.repair(repair.damage(table(spark, folder, "conversations")))


@register("op12_source_divergence", divergence.report_sql())
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Differences between the sources of each language, and the terms that set each apart."""
    return divergence.audit(table(spark, folder, "documents"))


@register("op13_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every text; the query starts from an empty cache of its own, whatever ran before."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    spec = bpe.read_spec(vocabulary_file("word_bpe_49k.json"))
    return tokencounts.count_tokens(docs, spec, scratch_path(spark, "token-counts"))
