"""The subpackage's registered queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm import clustering, embedding_dedup, exact_topk, lang_id, minhash_dedup, mixing, packing, quality, secrets, toxicity, url_filter, warc, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return lang_id.identified(_read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents that bring each source to its target."""
    rows = mixing.copies(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors at cosine 0.95."""
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every vector whose id is divisible by 50."""
    return exact_topk.top_k(_read(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    return toxicity.judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents at 0.85 on five-word shingles."""
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return url_filter.judged(_read(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of at most 1024 tokens."""
    return packing.packed(_read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, and the archives read back."""
    return warc.round_trip(_read(spark, sf_dir, "pages"), spark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    return quality.judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first four whitened components."""
    return whitening.whitened(_read(spark, sf_dir, "embeddings"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 40 clusters after five rounds."""
    return clustering.clustered(_read(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return secrets.found(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lang_id": op1_lang_id,
    "op2_mixing": op2_mixing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_exact_topk": op4_exact_topk,
    "op5_toxicity": op5_toxicity,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_clustering": op12_clustering,
    "op13_secrets": op13_secrets,
}

_TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum([q.v[i] * d.v[i] FOR i IN range(1, 1 + least(len(q.v), len(d.v)))]) AS BIGINT) AS score
  FROM usable q JOIN usable d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_WARC_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), tops AS (
  SELECT html, max(page_id) AS top FROM payloads WHERE payload_bytes >= 1000 GROUP BY html
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN t.top IS NOT NULL AND p.page_id IS DISTINCT FROM t.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN t.top IS NOT NULL AND p.page_id IS DISTINCT FROM t.top THEN t.top END AS refers_to
FROM payloads p LEFT JOIN tops t ON p.html = t.html AND p.payload_bytes >= 1000
"""


def _clustering_sql(count: int, rounds: int, wide: int) -> str:
    """Lloyd's rounds, one CTE each; floors of means by non-negative remainders."""
    nearest = (
        "a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT k.r, m.c, CAST(list_sum([(k.x[j] - m.x[j]) * (k.x[j] - m.x[j]) FOR j IN range(1, {wide} + 1)]) AS BIGINT) AS d, m.x AS mx FROM kept k, c{i} m) "
        "QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"
    )
    moved = (
        "c{j} AS MATERIALIZED (SELECT m.c, coalesce(s.x, m.x) AS x FROM c{i} m LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS x "
        "FROM (SELECT c, p, sum(v) AS s, count(*) AS n FROM (SELECT a.c, unnest(k.x) AS v, unnest(range({wide})) AS p FROM a{i} a JOIN kept k USING (r)) GROUP BY 1, 2) GROUP BY 1) s ON s.c = m.c)"
    )
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) = {wide} AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {count})",
    ]
    for i in range(rounds):
        parts += [nearest.format(i=i, wide=wide), moved.format(i=i, j=i + 1, wide=wide)]
    parts.append(nearest.format(i=rounds, wide=wide))
    return f"""WITH {", ".join(parts)}
    SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(m.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN kept k USING (r) JOIN c{rounds} m ON m.c = a.c"""


def _secrets_sql() -> str:
    """Match ends are running sums over matches and gaps; owners are counted by hash."""
    quoted = lambda p: p.replace("'", "''")
    base = f"{secrets.ASSIGN}|{secrets.ACCESS}|{secrets.HEX}"
    patterns = [secrets.ASSIGN, secrets.ACCESS, secrets.HEX, f"{base}|{secrets.TOKEN}"]
    raw = " UNION ALL ".join(
        f"SELECT r, {place} AS place, unnest(m) AS m, unnest(g) AS g, unnest(range(len(m))) AS i FROM (SELECT r, m, string_split_regex(text, '{quoted(p)}')[1:len(m)] AS g "
        f"FROM (SELECT r, text, regexp_extract_all(text, '{quoted(p)}', 0) AS m FROM docs) WHERE len(m) > 0)"
        for place, p in enumerate(patterns)
    )
    names = "['assign', 'access', 'hex', 'token'][place + 1] || ':' || s || ':' || e"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
    raw AS ({raw}),
    placed AS (SELECT r, place, m, CAST(sum(length(m) + length(g)) OVER (PARTITION BY r, place ORDER BY i) AS BIGINT) AS e FROM raw),
    spans AS MATERIALIZED (SELECT r, place, m, e - length(m) AS s, e, CASE WHEN place = 0 THEN regexp_extract(m, '{quoted(secrets.ASSIGN)}', 2) ELSE m END AS v FROM placed
      WHERE CASE place WHEN 0 THEN length(regexp_extract(m, '{quoted(secrets.ASSIGN)}', 2)) >= {secrets.LEAST_VALUE}
        WHEN 3 THEN regexp_full_match(m, '{secrets.TOKEN}') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, '{quoted(base)}') AND NOT regexp_matches(m, '{secrets.KEYWORD_LAST}')
        ELSE TRUE END),
    owners AS (SELECT v, count(DISTINCT coalesce('=' || source, 'row ' || r)) AS owners, count(DISTINCT coalesce('=' || doc_id, 'row ' || r)) AS repositories, bool_or(place < 3) AS assigned FROM spans JOIN docs USING (r) GROUP BY 1),
    judged AS (SELECT r, place, s, e, owners, assigned,
        regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {secrets.LEAST_VARIETY} AND NOT regexp_matches(v, '{secrets.FILLER}')
          AND owners = 1 AND repositories <= {secrets.FEW_REPOSITORIES} AS live,
        length(v) >= {secrets.LEAST_GENERATED} AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') AS generated
      FROM spans JOIN owners USING (v)),
    listed AS (SELECT r, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
        string_agg({names}, ',' ORDER BY s, place) FILTER (place < 3) AS base, string_agg({names}, ',' ORDER BY s, place) AS spans,
        string_agg({names}, ',' ORDER BY s, place) FILTER (owners < {secrets.MANY_OWNERS} AND live) AS live, string_agg({names}, ',' ORDER BY s, place) FILTER (owners >= {secrets.MANY_OWNERS}) AS copied
      FROM judged WHERE place < 3 OR live AND (generated OR assigned) GROUP BY 1)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
      coalesce(spans, '') AS spans, coalesce(live, '') AS live_spans, coalesce(copied, '') AS copied_spans FROM docs LEFT JOIN listed USING (r)"""


ORACLES: dict[str, str] = {
    "op4_exact_topk": _TOPK_SQL,
    "op9_warc": _WARC_SQL,
    "op12_clustering": _clustering_sql(clustering.CENTROIDS, clustering.ROUNDS, clustering.WIDE),
    "op13_secrets": _secrets_sql(),
}
