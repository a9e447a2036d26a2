"""URL verdicts: host and path rules first, then a logistic regression on hashed character n-grams of host and path.

DataFrame functions only. Training folds gradient steps over one row that holds the whole (bounded) labelled table; scoring
is one projection over the URLs, without a shuffle or a join. The model is an array of BUCKETS + 1 doubles. The labelled table is
url_table's, or one that is passed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.llm import url_table
from lorewright.llm.shared import drop, written

BUCKETS = 8192
GRAM = 3
#: Accelerated gradient steps; RATE is their length, DECAY the weights' penalty.
STEPS = 150
RATE = 2.0
DECAY = 0.002
#: At most so many labelled URLs are learned from, those of smallest hash.
MOST_LABELLED = 5000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked) of the built-in table."""
    values = ", ".join(f"('{url}', {blocked})" for url, blocked in url_table.rows())
    return spark.sql(f"SELECT * FROM VALUES {values} AS labelled(url, blocked)")  # no Python workers


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no '://'."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _grams(text: Column, tag: str) -> Column:
    """Buckets of the n-grams of the text between ^ and $; the text is split once."""
    chars = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
    bucket = lambda all_, c, i: F.pmod(F.hash(F.lit(tag), c, *[F.get(all_, i + k) for k in range(1, GRAM)]), F.lit(BUCKETS))
    every = lambda all_: F.transform(all_, lambda c, i: bucket(all_, c, i))
    return F.get(F.transform(F.array(chars), every), F.lit(0))


def features(host: Column, path: Column) -> Column:
    """The distinct buckets of a URL's n-grams; never empty, as both parts are framed."""
    return F.array_distinct(F.concat(_grams(host, "h"), _grams(path, "p")))


def _margin(weights: Column, found: Column) -> Column:
    return F.get(weights, F.lit(BUCKETS)) + F.aggregate(found, F.lit(0.0), lambda a, i: a + F.get(weights, i)) / F.sqrt(F.size(found))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def train(labelled: DataFrame, most: int = MOST_LABELLED, steps: int = STEPS) -> list[float]:
    """Weights by bucket, then the bias. Rows with a null label are left out; an empty table gives zeros, so that every
    score is 0.5. Rows are taken in the order of their URLs' hashes, so reruns agree.

    A URL's features weigh 1 / sqrt of their number, so its vector has length 1, and with the bias sqrt 2; the loss's
    curvature is then 0.5 at most, and steps of RATE = 2 over it with momentum converge."""
    picked = labelled.where("blocked is not null").select("url", F.col("blocked").cast("double").alias("y"))
    picked = picked.orderBy(F.xxhash64("url"), "url", "y").limit(most)
    numbered = picked.withColumn("k", F.row_number().over(Window.orderBy(F.xxhash64("url"), "url", "y")) - 1)  # `most` rows at most
    numbered = written(numbered.select("k", "y", features(*parts(F.col("url"))).alias("f")), "labelled")
    rows = numbered.agg(F.sort_array(F.collect_list(F.struct("k", "y", "f"))).alias("rows"))
    lists = numbered.select("k", F.explode("f").alias("i")).groupBy("i").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    lists = lists.agg(F.sort_array(F.collect_list(F.struct("i", "ks"))).alias("lists"))
    table = rows.withColumn("lists", F.lit(None).cast("array<struct<i:int,ks:array<int>>>"))
    table = table.unionByName(lists.select(F.lit(None).cast("array<struct<k:int,y:double,f:array<int>>>").alias("rows"), "lists"))
    table = table.agg(F.first("rows", True).alias("rows"), F.first("lists", True).alias("lists"))
    # features are numbered densely for the fit: a row's are places in lists, from 1
    places = F.map_from_arrays(F.transform("lists", lambda x: x["i"]), F.sequence(F.lit(1), F.size("lists")))
    table = written(table.where("size(rows) > 0").withColumn("places", places), "labelled")
    dense = lambda r: F.struct(r["y"].alias("y"), F.transform(r["f"], lambda i: F.element_at("places", i)).alias("f"), (1 / F.sqrt(F.size(r["f"]))).alias("scale"))
    one = written(table.select("lists", F.transform("rows", dense).alias("rows")), "labelled")
    n = F.size("rows")

    def step(state: Column, t: Column) -> Column:
        """state: the weights, the bias last, and the point that momentum has led to."""
        bias = lambda v: F.get(v, F.size("lists"))
        margin = lambda v, r: bias(v) + F.aggregate(r["f"], F.lit(0.0), lambda a, i: a + F.get(v, i - 1)) * r["scale"]
        errors = lambda v: F.transform("rows", lambda r: (r["y"] - _sigmoid(margin(v, r))) * r["scale"])
        plain = lambda v: F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["y"] - _sigmoid(margin(v, r)))
        pull = lambda e, x: F.aggregate(x["ks"], F.lit(0.0), lambda a, k: a + F.get(e, k))
        moved = lambda v, e: F.transform("lists", lambda x, j: F.get(v, j) + RATE * (pull(e, x) / n - DECAY * F.get(v, j)))
        new = lambda v: F.get(F.transform(F.array(errors(v)), lambda e: F.concat(moved(v, e), F.array(bias(v) + RATE * plain(v) / n))), F.lit(0))
        led = lambda w, w0: F.zip_with(w, w0, lambda a, b: a + t / (t + 3) * (a - b))
        both = F.transform(F.array(new(F.get(state, F.lit(1)))), lambda w: F.array(w, led(w, F.get(state, F.lit(0)))))
        return F.get(both, F.lit(0))

    start = F.array_repeat(F.array_repeat(F.lit(0.0), F.size("lists") + 1), 2)
    fitted = one.select("lists.i", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("w")).first()
    drop(numbered, table, one)
    weights = [0.0] * (BUCKETS + 1)
    if fitted:
        for i, w in zip([*fitted["i"], BUCKETS], fitted["w"][0], strict=True):
            weights[i] = w
    return weights


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages (page_id, url; other columns are left).

    A rule fits its host and all subdomains where the path starts with the rule's; of several the longest text wins, then
    the longer host. Where none fits, verdict is block where the regression's score is 0.5 or more. Null and malformed
    URLs have empty host and path and are judged by the regression. Repeated rows stay; an empty table gives no rows.
    """
    weights = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    model = F.expr("array(" + ",".join(f"{w!r}D" for w in weights) + ")")
    host, path = parts(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    chosen = lambda f: F.coalesce(*[F.when(fits(r), F.lit(f(r))) for r in ordered], F.lit(None).cast("string"))
    score = _sigmoid(_margin(model, features(F.col("host"), F.col("path"))))
    out = out.select("page_id", "host", "path", chosen(lambda r: r.text).alias("rule"), chosen(lambda r: r.verdict).alias("ruled"), score.alias("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
