"""Registered queries of this folder, each over its whole table, and their SQL where it exists."""

import functools

import public_tokenizers
from pyspark.sql import functions as F

from newstide.llm.bitplane import CENTROIDS, ROUNDS as CLUSTER_ROUNDS, clusters_with_inertia
from newstide.llm.bpe import round_trip
from newstide.llm.common import table
from newstide.llm.decontaminate import WINDOW, match_items, span_words
from newstide.llm.exact_dedup import exact_duplicates
from newstide.llm.gnat import ENTRIES, PARTS, ROUNDS as CODE_ROUNDS, codes_with_errors
from newstide.llm.packing import pack
from newstide.llm.quality import judge_quality
from newstide.llm.secrets import scan_secrets
from newstide.llm.sharding import hilbert_shards
from newstide.llm.simhash import near_duplicates
from newstide.llm.token_counts import count_tokens
from newstide.llm.toxicity import score_toxicity
from newstide.llm.url_filter import filter_urls
from newstide.sources.layout import ensure_shared_dir


def op1_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"),
                      public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN)


def op3_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op4_url_filter(spark, sf_dir):
    found = filter_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def op5_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark, sf_dir):
    found = judge_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept", "p_good")


def op7_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op8_hilbert_sharding(spark, sf_dir):
    found = hilbert_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"))


def op11_benchmark_decontamination(spark, sf_dir):
    found = match_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = span_words(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def op12_centroid_clustering(spark, sf_dir):
    return clusters_with_inertia(table(spark, sf_dir, "embeddings"))


def op13_vector_code_compression(spark, sf_dir):
    return codes_with_errors(table(spark, sf_dir, "embeddings"))


def _registered(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ensure_shared_dir(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {query.__name__: _registered(query) for query in (
    op1_secret_scan, op2_byte_bpe, op3_exact_dedup, op4_url_filter, op5_toxicity,
    op6_quality_rules, op7_best_fit_packing, op8_hilbert_sharding, op9_simhash_near_dedup,
    op10_token_counts, op11_benchmark_decontamination, op12_centroid_clustering,
    op13_vector_code_compression)}

def _windows_sql() -> str:
    """Windows of items met in documents by equality of their text."""
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w")
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {words} FROM documents),
        items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} FROM benchmark),
        parts AS (
            SELECT item, w, least(len(w), {WINDOW}) AS n,
                   unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS pos
            FROM items WHERE len(w) > 0),
        wanted AS (SELECT DISTINCT item, n, array_to_string(w[pos:pos + n - 1], ' ') AS words
                   FROM parts),
        sizes AS (SELECT DISTINCT n FROM wanted),
        places AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS pos
                   FROM docs JOIN sizes ON n <= len(w)),
        met AS (SELECT rid, pos, p.n, item
                FROM (SELECT rid, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS words
                      FROM places) p JOIN wanted USING (n, words)),
        hits AS (SELECT rid, count(DISTINCT word) AS n_hit
                 FROM (SELECT rid, unnest(range(pos, pos + n)) AS word FROM met) GROUP BY rid),
        named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)"""


# Integers floor(1024 * x) of the vectors without null, NaN and infinite components.
_SCALED = """list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))"""
_FINITE = """embedding IS NOT NULL AND
             len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _floor_mean(total: str, n: str) -> str:
    return f"({total} - (({total} % {n}) + {n}) % {n}) // {n}"


def _distance(a: str, b: str, width: int) -> str:
    return (f"list_sum(list_transform(range(1, {width + 1}), "
            f"lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))")


def _clusters_sql(rounds: int = CLUSTER_ROUNDS, width: int = 64) -> str:
    def assign(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
            SELECT rid, any_value(v.v) AS v, min(struct_pack(
                d := CAST({_distance("v.v", "c.v", width)} AS BIGINT), k := c.k)) AS best
            FROM kept v, c{k} c GROUP BY rid)"""

    steps = [assign(0)]
    for k in range(1, rounds + 1):
        mean = _floor_mean("s", "n")
        steps += [f"""m{k} AS MATERIALIZED (
            SELECT k, list({mean} ORDER BY pos) AS v FROM (
                SELECT k, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
                    SELECT best.k AS k, unnest(v) AS x, unnest(range(1, {width + 1})) AS pos
                    FROM a{k - 1}) GROUP BY k, pos) GROUP BY k)""",
                  f"""c{k} AS MATERIALIZED (
            SELECT c.k, coalesce(m.v, c.v) AS v FROM c{k - 1} c LEFT JOIN m{k} m ON c.k = m.k)""",
                  assign(k)]
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, {_SCALED} AS v FROM embeddings
            WHERE {_FINITE} AND len(embedding) = {width}),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (
                SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h, v
                LIMIT {CENTROIDS})),
        {", ".join(steps)}
        SELECT vec_id, CAST(best.k AS INT) AS cluster, best.d AS distance,
               CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN kept USING (rid) JOIN c{rounds} c ON c.k = a.best.k"""


def _codes_sql(rounds: int = CODE_ROUNDS, width: int = 64) -> str:
    size = width // PARTS

    def assign(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
            SELECT rid, p.part, any_value(p.v) AS v, min(struct_pack(
                d := CAST({_distance("p.v", "c.v", size)} AS BIGINT), k := c.k)) AS best
            FROM parts p JOIN c{k} c ON c.part = p.part GROUP BY rid, p.part)"""

    steps = [assign(0)]
    for k in range(1, rounds + 1):
        mean = _floor_mean("s", "n")
        steps += [f"""m{k} AS MATERIALIZED (
            SELECT part, k, list({mean} ORDER BY pos) AS v FROM (
                SELECT part, k, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
                    SELECT part, best.k AS k, unnest(v) AS x, unnest(range(1, {size + 1})) AS pos
                    FROM a{k - 1}) GROUP BY part, k, pos) GROUP BY part, k)""",
                  f"""c{k} AS MATERIALIZED (
            SELECT c.part, c.k, coalesce(m.v, c.v) AS v
            FROM c{k - 1} c LEFT JOIN m{k} m ON c.k = m.k AND c.part = m.part)""",
                  assign(k)]
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, label, {_SCALED} AS v FROM embeddings
            WHERE {_FINITE}),
        parts AS MATERIALIZED (
            SELECT rid, vec_id, part, v[part * {size} + 1:(part + 1) * {size}] AS v
            FROM (SELECT *, unnest(range({PARTS})) AS part FROM kept)),
        c0 AS MATERIALIZED (
            SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id, v) - 1 AS k, v
            FROM parts QUALIFY k < {ENTRIES}),
        {", ".join(steps)},
        codes AS (
            SELECT rid, string_agg(printf('%02x', best.k), '' ORDER BY part) AS code,
                   CAST(sum(best.d) AS BIGINT) AS error
            FROM a{rounds} GROUP BY rid),
        books AS (
            SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, k)) AS digest
            FROM c{rounds})
        SELECT vec_id, code, error,
               CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT digest FROM books) AS codebooks_sha256
        FROM codes JOIN kept USING (rid)"""


SQL = {
    "op3_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
            FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM norm WINDOW same AS (PARTITION BY norm)""",
    "op11_benchmark_decontamination": _windows_sql(),
    "op12_centroid_clustering": _clusters_sql(),
    "op13_vector_code_compression": _codes_sql(),
}
