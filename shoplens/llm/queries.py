"""Queries ``opN_<name>`` over the whole given tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.bpe import digests
from shoplens.llm.chunking import dedup_substrings
from shoplens.llm.clustering import centroid_clusters
from shoplens.llm.conversations import damaged, repair_summaries
from shoplens.llm.cover_tree import top_k
from shoplens.llm.decontamination import find_overlaps
from shoplens.llm.html_text import extract_text
from shoplens.llm.language_id import identify
from shoplens.llm.language_model import score_held_out
from shoplens.llm.licences import EQUIVALENTS, KNOWN, NO_WORD, RIGHTS_LINE, scan_licences
from shoplens.llm.sharding import assign_shards
from shoplens.llm.simhash import near_components
from shoplens.llm.token_files import token_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(documents(spark, folder), shards=24)


@query
def op6_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(documents(spark, folder))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_lines_sql(text: str) -> str:
    words = f"trim(regexp_replace(regexp_replace(lower(x), {_quoted(RIGHTS_LINE)}, ''), {_quoted(NO_WORD)}, ' ', 'g'))"
    for other, chosen in EQUIVALENTS:
        words = f"replace({words}, {_quoted(other)}, {_quoted(chosen)})"
    return rf"list_filter(list_transform(regexp_split_to_array({text}, '\r\n|\r|\n'), lambda x: {words}), lambda x: x <> '')"


ORACLES["op6_licence_scan"] = f"""
WITH known(licence, body) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(b)})" for n, b in KNOWN)}),
digests AS (
    SELECT sha256(array_to_string({_canonical_lines_sql("body")}, ' ')) AS digest, min(licence) AS licence
    FROM known GROUP BY 1),
lines AS (SELECT doc_id, {_canonical_lines_sql("coalesce(text, '')")} AS lines FROM documents),
line_hits AS (
    SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences
    FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM lines) JOIN digests USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS text_digest FROM lines)
SELECT doc_id, text_digest, licence, coalesce(line_licences, '') AS line_licences
FROM whole LEFT JOIN digests ON text_digest = digest LEFT JOIN line_hits USING (doc_id)
"""


def word_bpe() -> str:
    """The tokenizer file of the contracts of op7 and op8; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_index(documents(spark, folder), word_bpe())


@query
def op8_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(documents(spark, folder), word_bpe())


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_components(documents(spark, folder), words=4, max_bits=4)


@query
def op1_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    return score_held_out(documents(spark, folder))


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(documents(spark, folder))


@query
def op5_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_substrings(documents(spark, folder))
    return found.select(
        "doc_id", "n_chunks", "n_repeats", "removed_bytes", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query
def op9_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return find_overlaps(documents(spark, folder), benchmark).drop("body")


@query
def op2_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{folder}/embeddings.parquet"))


ORACLES["op2_cover_tree"] = """
WITH valid AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.v, p.v) AS BIGINT) AS score
    FROM valid q JOIN valid p ON q.vec_id <> p.vec_id AND len(q.v) = len(p.v) WHERE q.vec_id % 20 = 0),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{folder}/embeddings.parquet"), k=16, rounds=3, dims=64)


def _clusters_sql(k: int, rounds: int, dims: int) -> str:
    """Lloyd's rounds with every vector compared with every centroid, one row per component."""
    steps = [f"""
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM vectors),
starts AS (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM vectors
    QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= {k}),
centroids0 AS (SELECT cluster, place, x FROM starts JOIN parts USING (vec_id))"""]
    for n in range(rounds + 1):
        steps.append(f"""
distances{n} AS (
    SELECT p.vec_id, c.cluster, sum((p.x - c.x) * (p.x - c.x)) AS distance
    FROM parts p JOIN centroids{n} c USING (place) GROUP BY ALL),
assigned{n} AS (
    SELECT vec_id, cluster, distance FROM distances{n}
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if n < rounds:
            steps.append(f"""
sums{n} AS (SELECT cluster, place, sum(x) AS s, count(*) AS m FROM assigned{n} JOIN parts USING (vec_id) GROUP BY ALL),
centroids{n + 1} AS (
    SELECT cluster, place, CAST(coalesce((s - ((s % m) + m) % m) // m, x) AS BIGINT) AS x
    FROM centroids{n} LEFT JOIN sums{n} USING (cluster, place))""")
    return ",".join(steps) + f""",
digests AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM centroids{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM assigned{rounds} JOIN digests USING (cluster)
"""


ORACLES["op13_centroid_clusters"] = _clusters_sql(k=16, rounds=3, dims=64)


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_summaries(damaged(spark.read.parquet(f"{folder}/conversations.parquet")))


@query
def op12_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
