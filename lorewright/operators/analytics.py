"""Statistics, listings and the dashboards' aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.operators.graph import degrees

FALLBACK = "_unsorted"


def counts_by(entries: DataFrame, column: str) -> DataFrame:
    """(value, n); null and empty values are '<null>'."""
    return entries.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("<null>")).alias("value")).agg(F.count("*").alias("n"))


def domain_list(entries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(domain, n, last_updated) of the entries' domains, the vocabulary (domain) and the fallback."""
    used = entries.groupBy(F.coalesce(F.nullif("domain", F.lit("")), F.lit(FALLBACK)).alias("domain")).agg(F.count("*").alias("n"), F.max("updated_at").alias("last_updated"))
    names = vocabulary.select("domain").unionAll(vocabulary.sparkSession.range(1).select(F.lit(FALLBACK).alias("domain"))).distinct()
    return used.join(names, "domain", "full").select("domain", F.coalesce("n", F.lit(0)).alias("n"), "last_updated")


def placed(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with place, from 1 within group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def top_per_group(rows: DataFrame, group: str, most: int, *order: Column) -> DataFrame:
    """The first `most` rows of each group. The window's group limit runs before the shuffle."""
    return placed(rows, group, *order).where(F.col("place") <= most)


def kind_shares(entries: DataFrame) -> DataFrame:
    """(domain, kind, n, share) within domains."""
    counts = entries.groupBy(F.coalesce(F.nullif("domain", F.lit("")), F.lit(FALLBACK)).alias("domain"), "kind").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("domain")))


def theme_map(entries: DataFrame, authority: DataFrame) -> DataFrame:
    """(domain, n, mean_authority)."""
    met = entries.join(authority, "id", "left")
    return met.groupBy(F.coalesce(F.nullif("domain", F.lit("")), F.lit(FALLBACK)).alias("domain")).agg(F.count("*").alias("n"), F.avg(F.coalesce("authority", F.lit(0.0))).alias("mean_authority"))


def cross_domain(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(left_domain, right_domain, n): edges between two domains, in either direction."""
    named = entries.where("domain is not null and domain <> ''").select("id", "domain")
    met = edges.join(named.select(F.col("id").alias("source_id"), F.col("domain").alias("a")), "source_id").join(named.select(F.col("id").alias("target_id"), F.col("domain").alias("b")), "target_id").where("a <> b")
    return met.groupBy(F.least("a", "b").alias("left_domain"), F.greatest("a", "b").alias("right_domain")).agg(F.count("*").alias("n"))


def relation_summary(entries: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(id, direction, type, n, first_ids): relations by type and direction, with the first ids."""
    out = edges.select(F.col("source_id").alias("id"), F.lit("out").alias("direction"), "type", F.col("target_id").alias("other"))
    both = out.unionAll(edges.select(F.col("target_id").alias("id"), F.lit("in").alias("direction"), "type", F.col("source_id").alias("other")))
    own = both.join(entries.select("id"), "id", "left_semi")
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("id", "direction", "type").orderBy("other")))
    return ranked.groupBy("id", "direction", "type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.col("other")))), ",").alias("first_ids"))


def graph_stats(entries: DataFrame, edges: DataFrame, authority: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolated, and the smallest, largest and mean authority."""
    near = degrees(entries, edges).join(authority, "id", "left")
    sums = near.agg(F.count("*").alias("nodes"), F.count(F.when(F.col("degree") == 0, 1)).alias("isolated"), F.min("authority").alias("least"), F.max("authority").alias("most"), F.avg("authority").alias("mean"))
    return sums.join(edges.agg(F.count("*").alias("edges")), F.lit(True))


def grade(value: Column, bounds: tuple[float, ...]) -> Column:
    """A letter by falling bounds: A from the first, E below the last of four."""
    out = F.lit("E")
    for letter, bound in reversed(list(zip("ABCD", bounds, strict=True))):
        out = F.when(value >= bound, letter).otherwise(out)
    return out


def health(entries: DataFrame, edges: DataFrame, authority: DataFrame) -> DataFrame:
    """One row: connectivity, top5 concentration of authority, maturity (active or authoritative), draft ratio, grades."""
    facts = degrees(entries, edges).join(entries.select("id", "status"), "id").join(authority, "id", "left").withColumn("authority", F.coalesce("authority", F.lit(0.0)))
    top = facts.orderBy(F.desc("authority"), "id").limit(5).agg(F.sum("authority").alias("top5"))
    ratio = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    sums = facts.agg(ratio(F.col("degree") > 0).alias("connectivity"), ratio(F.col("status").isin("active", "authoritative")).alias("maturity"), ratio(F.col("status") == "draft").alias("drafts"), F.sum("authority").alias("total"))
    row = sums.join(top, F.lit(True)).withColumn("concentration", F.coalesce(F.try_divide("top5", "total"), F.lit(0.0)))
    return row.select("connectivity", "concentration", "maturity", "drafts", grade(F.col("connectivity"), (0.9, 0.75, 0.6, 0.4)).alias("connectivity_grade"), grade(F.col("maturity"), (0.7, 0.55, 0.4, 0.2)).alias("maturity_grade"))


def summary_line(body: Column, longest: int = 88, least: int = 4) -> Column:
    """The first readable line: no heading, table, list, quote or fence; inline markup stripped."""
    lines = F.transform(F.split(body, "\n"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`]", "")))
    readable = F.filter(lines, lambda s: (F.length(s) >= least) & ~s.rlike(r"^(#|\||>|```|[-+*] |\d+\. )"))
    return F.substring(F.get(readable, 0), 1, longest)


def recall_mrr(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query, recall, mrr): results (query, place from 1, id) against relevant (query, id)."""
    hits = results.where(F.col("place") <= k).join(relevant, ["query", "id"], "left_semi").groupBy("query").agg(F.countDistinct("id").alias("hits"), F.min("place").alias("first"))
    wanted = relevant.groupBy("query").agg(F.countDistinct("id").alias("wanted"))
    return wanted.join(hits, "query", "left").select("query", (F.coalesce("hits", F.lit(0)) / F.col("wanted")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def ndcg(results: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg): gain 2 ** grade - 1, discount log2(place + 1); 0 where nothing is relevant."""
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / (F.log(F.col("place") + 1.0) / F.log(F.lit(2.0)))
    got = results.where(F.col("place") <= k).join(grades, ["query", "id"]).groupBy("query").agg(F.sum(gain).alias("dcg"))
    best = placed(grades, "query", F.desc("grade"), F.col("id")).where(F.col("place") <= k).groupBy("query").agg(F.sum(gain).alias("ideal"))
    return best.join(got, "query", "left").select("query", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def confidence_value(confidence: Column) -> Column:
    """What a confidence word counts: high 0.85, medium 0.5, low 0.25, none 0.15, any other 0.5."""
    return F.when(confidence.isNull() | (confidence == ""), 0.15).when(confidence == "high", 0.85).when(confidence == "medium", 0.5).when(confidence == "low", 0.25).otherwise(0.5)


def authority_scales(authority: Column) -> list[Column]:
    """size, percent and norm of an authority for display."""
    unit = F.greatest(F.least(authority, F.lit(1.0)), F.lit(0.0))
    return [(8 + 10 * F.sqrt(unit)).alias("size"), F.greatest(F.least(F.round(authority * 100), F.lit(100.0)), F.lit(3.0)).alias("percent"), unit.alias("norm")]


def verdicts(entries: DataFrame) -> DataFrame:
    """One row: the dominant kind where it holds half, and words for maturity and freshness shares."""
    total = entries.agg(F.count("*").alias("total"), F.avg(F.when(F.col("status").isin("active", "authoritative"), 1.0).otherwise(0.0)).alias("mature"), F.avg(F.when(F.col("freshness") == "volatile", 1.0).otherwise(0.0)).alias("volatile"))
    top = entries.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(1)
    row = total.join(top, F.lit(True), "left")
    return row.select(F.when(F.col("n") >= 0.5 * F.col("total"), F.col("kind")).alias("dominant"), F.when(F.col("mature") >= 0.7, "mature").when(F.col("mature") >= 0.4, "growing").otherwise("young").alias("maturity"), F.when(F.col("volatile") <= 0.2, "calm").when(F.col("volatile") <= 0.6, "mixed").otherwise("restless").alias("freshness"))


def orphan_domains(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain) of domains without an edge to another one."""
    linked = cross_domain(entries, edges).select(F.explode(F.array("left_domain", "right_domain")).alias("domain"))
    return entries.where("domain <> ''").select("domain").distinct().join(linked, "domain", "left_anti")


def backlinks(edges: DataFrame) -> DataFrame:
    """(id, type, n): incoming relations by type."""
    return edges.groupBy(F.col("target_id").alias("id"), "type").agg(F.count("*").alias("n"))


def chain_links(entries: DataFrame, edges: DataFrame, chain: tuple[str, ...]) -> DataFrame:
    """(source_id, target_id, from_place, to_place): derived_from edges with both ends in the promotion chain."""
    place = entries.select("id", F.array_position(F.array(*[F.lit(k) for k in chain]), F.col("kind")).cast("int").alias("p")).where("p > 0")
    own = edges.where("type = 'derived_from'").join(place.select(F.col("id").alias("source_id"), F.col("p").alias("from_place")), "source_id").join(place.select(F.col("id").alias("target_id"), F.col("p").alias("to_place")), "target_id")
    return own.select("source_id", "target_id", "from_place", "to_place")
