"""Secrets in whole texts, and who owns them: corpus-wide ownership frequency of candidate values.

Candidates are the base patterns' matches (assign, access, hex) and bare tokens, runs of 16 or more key characters with a
letter and a digit. A value's SHA-256, never the value, is counted over the corpus by distinct repositories and distinct
owners. A value of many owners is a copied example; a value of one owner in few repositories that looks live (no filler, enough
different characters) is a live credential. A bare token becomes a span of kind token where it is live and either has
the mixture of a generated key or is known as the value of an assignment somewhere in the corpus.

Everything is DataFrame functions. A text's match ends are running sums of the lengths of matches and of what lies between
them, so positions cost one more split of the text, not a search per match. The scan is written once, without texts. A
value that very many rows hold is counted by partial aggregates, and its verdict comes by a join whose large partitions
adaptive execution splits; its other side has one row a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.llm.shared import written

#: Kinds in the order that equal starts have, and the patterns of the base kinds (fixed values).
KINDS = ("assign", "access", "hex", "token")
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
LEAST_VALUE = 8
#: A bare token, and the keyword that would make its end the start of an assignment.
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
KEYWORD_LAST = "(?i)(password|passwd|secret|token|api_?key)$"
#: Fillers of documentation; a value that holds one isn't live.
FILLER = "(?i)example|sample|dummy|placeholder|changeme|redacted|your|xxxx|0000|1234|abcd"
#: Owners from which a value counts as copied; repositories up to which one owner's value counts as live; different
#: characters that a live value has at least; length from which upper case, lower case and digits make a generated key.
MANY_OWNERS, FEW_REPOSITORIES, LEAST_VARIETY, LEAST_GENERATED = 3, 5, 6, 20
_BLOCK = 128


def running(steps: Column) -> Column:
    """The running sums of a non-empty array<int>, by blocks, so that arrays that grow by one stay short."""
    add = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    starts = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(starts, lambda i: F.slice(steps, i * _BLOCK + 1, F.lit(_BLOCK)))
    before = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)), F.array(F.lit(0)), add)
    within = F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, s: F.aggregate(b, F.array(s), add))
    return F.flatten(F.transform(within, lambda sums: F.slice(sums, F.lit(2), F.size(sums) - 1)))


def _matches(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """rows with array<struct<m, end>> of the text's leftmost non-overlapping matches as column `name`."""
    p, found, ends = F.lit(pattern), f"_{name}_m", f"_{name}_end"
    none = F.array().cast("array<string>")
    rows = rows.withColumn(found, F.when(F.col("text").rlike(pattern), F.regexp_extract_all("text", p, F.lit(0))).otherwise(none))
    gaps = F.when(F.size(found) > 0, F.split("text", pattern, -1)).otherwise(none)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.col(found), lambda g, m: F.length(g) + F.length(m))
    rows = rows.withColumn(ends, F.when(F.size(found) > 0, running(steps)).otherwise(F.array().cast("array<int>")))
    return rows.withColumn(name, F.zip_with(found, ends, lambda m, e: F.struct(m.alias("m"), e.alias("end")))).drop(found, ends)


def _span(kind: str, value) -> object:
    """Of a match: its span, its value's hash, and how the value looks."""

    def one(x: Column) -> Column:
        v = value(x["m"])
        variety = F.size(F.array_distinct(F.split(v, "")))
        live = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (variety >= LEAST_VARIETY) & ~v.rlike(FILLER)
        generated = (F.length(v) >= LEAST_GENERATED) & v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
        return F.struct(
            (x["end"] - F.length(x["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("place"), x["end"].alias("end"), F.unhex(F.sha2(v.cast("binary"), 256)).alias("hash"),
            live.alias("live"), generated.alias("generated"),
        )

    return one


def scanned(documents: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(row, doc_id, owner, repository, spans): each text's candidates, base ones first; a row of the table is one row."""
    whole = lambda m: m
    group_2 = lambda m: F.regexp_extract(m, ASSIGN, 2)
    rows = documents.select("doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.coalesce("text", F.lit("")).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", f"{ASSIGN}|{ACCESS}|{HEX}|{TOKEN}")):
        rows = _matches(rows, name, pattern)
    base = f"{ASSIGN}|{ACCESS}|{HEX}"
    bare = lambda x: x["m"].rlike(f"^{TOKEN}$") & x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & ~x["m"].rlike(base) & ~x["m"].rlike(KEYWORD_LAST)
    spans = F.concat(
        F.transform(F.filter("assign", lambda x: F.length(group_2(x["m"])) >= LEAST_VALUE), _span("assign", group_2)),
        F.transform("access", _span("access", whole)), F.transform("hex", _span("hex", whole)), F.transform(F.filter("token", bare), _span("token", whole)),
    )
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", spans.alias("spans")), "secrets")


def ownership(scan: DataFrame) -> DataFrame:
    """(hash, owners, repositories, assigned) of every value: how many distinct owners and repositories hold it, and whether a base
    pattern matched it. An unknown owner or repository counts as one of its own a row."""
    own = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.concat(F.lit("row "), F.col("row").cast("string")))
    rows = scan.select(own("owner").alias("owner"), own("repository").alias("repository"), F.explode("spans").alias("s"))
    rows = rows.groupBy(F.col("s.hash").alias("hash"), "owner", "repository").agg(F.max(F.col("s.place") < 3).alias("assigned"))
    return rows.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"), F.max("assigned").alias("assigned"))


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda place: F.element_at(F.array(*map(F.lit, KINDS)), place + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(documents: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per row of documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and of the spans those of live and
    those of copied values as live_spans and copied_spans, all ordered by start, then kind.

    documents: doc_id, text, and the columns that name a text's owner and repository; other columns are left, whatever their
    names. Positions are code points, ends exclusive. A null or empty text has no spans and the SHA-256 of the empty string;
    null ids and repeated rows each give their row. The tables here have no repositories, so each document stands for one and
    its source for the owner."""
    scan = scanned(documents, owner, repository)
    values = written(ownership(scan), "owners")  # a table of its own, so that both sides of the join are dealt for it alone
    each = scan.select("row", F.explode("spans").alias("s")).select("row", "s.*").join(values, "hash")
    live = F.col("live") & (F.col("owners") == 1) & (F.col("repositories") <= FEW_REPOSITORIES)
    verdict = F.when(F.col("owners") >= MANY_OWNERS, "copied").when(live, "live").otherwise("shared")
    keep = (F.col("place") < 3) | (live & (F.col("generated") | F.col("assigned")))
    each = each.where(keep).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", verdict.alias("verdict")))).alias("all"))
    rows = scan.select("row", "doc_id", _base(F.col("spans")).alias("base")).join(each, "row", "left")
    own = F.coalesce("all", F.array().cast(each.schema["all"].dataType))
    count = lambda place: F.size(F.filter("base", lambda s: s["place"] == place)).cast("long")
    return rows.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(own).alias("spans"),
        *[_listed(F.filter(own, _judged(v))).alias(f"{v}_spans") for v in ("live", "copied")],
    )


def _judged(verdict: str):
    return lambda s: s["verdict"] == verdict


def _base(spans: Column) -> Column:
    return F.array_sort(F.transform(F.filter(spans, lambda s: s["place"] < 3), lambda s: F.struct(s["start"], s["place"], s["end"])))
