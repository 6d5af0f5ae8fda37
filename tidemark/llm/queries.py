"""One thin query for each corpus operator: production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import clustering, decontamination, exact_dedup, html_text, language_id, license_scan, mixing, near_dedup, packing, quality, substring_dedup, tokens, vector_codes


#: The vocabulary that token counts and packing use unless another file is given.
VOCABULARY = "byte_bpe_50k.json"


def _vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return license_scan.scan(docs, license_scan.fit(docs))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, folder, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = quality.score(docs, quality.fit(docs, _table(spark, folder, "labels")))
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_texts(_table(spark, folder, "pages"))


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"), shingle=2, percent=80)


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents")).drop("n_chunks")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contained_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = tokens.count_tokens(_table(spark, folder, "documents"), _vocabulary())
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = tokens.token_pieces(_table(spark, folder, "documents"), _vocabulary(), capacity=2048)
    return packing.pack(pieces, capacity=2048).withColumnRenamed("id", "doc_id")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(_table(spark, folder, "embeddings"))[0]


def op12_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(_table(spark, folder, "embeddings"))[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: A-Z lower-cased and nothing else.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL = {
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOW} AS low FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(low) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY low)""",
}


def _floor(total: str, n: str) -> str:
    """The floor of a quotient of whole numbers; n is positive."""
    return f"(({total} - ((({total}) % {n}) + {n}) % {n}) // {n})"


def _op11(rounds: int = 10) -> str:
    """Lloyd's rounds one after another, each vector against every centroid."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS k, x AS c FROM v QUALIFY k < 8)",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT row, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
            SELECT row, k, list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS d FROM v, c{r}) GROUP BY row)""")
        if r < rounds:
            mean = _floor("s", "n")
            steps.append(f"""m{r} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(x) AS x, unnest(range(64)) AS i FROM a{r} JOIN v USING (row)) GROUP BY k, i)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT k, list({mean}::DOUBLE ORDER BY i) AS c FROM m{r} GROUP BY k) n ON o.k = n.k)""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, a.k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v USING (row) JOIN c{rounds} c ON c.k = a.k"""


def _op13(rounds: int = 4) -> str:
    """Lloyd's rounds one after another, each part against every entry of its position."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "p AS MATERIALIZED (SELECT row, j, x[16 * j + 1 : 16 * j + 16] AS x FROM v, (SELECT unnest(range(4)) AS j))",
        "c0 AS MATERIALIZED (SELECT j, row - 1 AS k, x AS c FROM p WHERE row <= 256)",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT row, j, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
            SELECT row, j, k, list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS d FROM p JOIN c{r} USING (j)) GROUP BY row, j)""")
        if r < rounds:
            mean = _floor("s", "n")
            steps.append(f"""m{r} AS (SELECT j, k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a{r}.j, k, unnest(x) AS x, unnest(range(16)) AS i FROM a{r} JOIN p ON p.row = a{r}.row AND p.j = a{r}.j) GROUP BY j, k, i)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.j, o.k, coalesce(n.c, o.c) AS c FROM c{r} o
                LEFT JOIN (SELECT j, k, list({mean}::DOUBLE ORDER BY i) AS c FROM m{r} GROUP BY j, k) n ON o.j = n.j AND o.k = n.k)""")
    return f"""WITH {", ".join(steps)},
        e AS (SELECT row, string_agg(printf('%02x', k::INTEGER), '' ORDER BY j) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row),
        b AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY j, k)) AS h FROM c{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, b.h AS codebooks_sha256 FROM e JOIN v USING (row), b"""


_SQL |= {
    "op11_centroid_clustering": _op11(),
    "op12_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS words, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM d GROUP BY source),
        o AS (SELECT *, (sum(words) OVER ())::BIGINT AS total, coalesce(sum(words) OVER (ORDER BY words / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
                     (sum(weight) OVER (ORDER BY words / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM s),
        c AS (SELECT *, weight * (total - 3 * below) > 3 * words * rest AS capped FROM o),
        l AS (SELECT (any_value(total) - 3 * coalesce(sum(words) FILTER (capped), 0))::BIGINT AS num, (sum(weight) FILTER (NOT capped))::BIGINT AS den FROM c),
        f AS (SELECT source, words, CASE WHEN capped THEN (3 * words)::DOUBLE ELSE weight::DOUBLE * num::DOUBLE / den::DOUBLE END AS target,
                     (CASE WHEN words = 0 THEN 0 WHEN capped THEN 3 ELSE weight * num END)::HUGEINT AS a, (CASE WHEN words = 0 OR capped THEN 1 ELSE words * den END)::HUGEINT AS b,
                     ('0x' || substr(md5('12:' || coalesce(source, '')), 1, 5))::BIGINT::HUGEINT AS draw FROM c, l),
        r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY size, md5(doc_id::VARCHAR), doc_id) - 1)::HUGEINT AS rank FROM d),
        n AS (SELECT doc_id, size, words AS source_size, target,
                     (((rank + 1) * a * 1048576 + draw * b) // (b * 1048576) - (rank * a * 1048576 + draw * b) // (b * 1048576))::BIGINT AS copies FROM r JOIN f ON r.source IS NOT DISTINCT FROM f.source)
        SELECT *, copies * size AS taken FROM n""",
    "op13_vector_codes": _op13(),
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
