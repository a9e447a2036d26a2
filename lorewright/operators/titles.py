"""Near titles of one kind, over all entries at once.

Two titles are near at a ratio of LEAST_RATIO (2 * longest common subsequence / both lengths), or where MOST_EDITS edits make
one of the other and the longer has LEAST_LENGTH characters. Equal titles are one class; classes are compared.

Inserting or deleting a character changes one count of a character by one, so titles whose counts are further apart than
their lengths allow can't be near. A kind's titles are dealt into blocks, every two blocks meet in one group, and what meets
is told apart by its counts: first by 128 bits a title, then by whole counts. What is left is compared exactly; nothing that is near is
missed. All titles of a kind meet, so the time grows with the square of their number, at a few nanoseconds a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import common_subsequence
from lorewright.plans.lineage import stored

#: Fixed values.
LEAST_RATIO, MOST_EDITS, LEAST_LENGTH = 0.85, 2, 4
#: Candidates that a finding names.
NAMED = 3
#: Titles of a block, kinds of character that are counted, and counts that the bits hold of each of half as many kinds.
BLOCK, COUNTED, BITS = 8192, 64, 4
_MET = "kind string, a string, a_title string, b string, b_title string, ratio double"


def classes(entries: DataFrame) -> DataFrame:
    """(kind, title, id, members): each title of a kind, sources left out, with its smallest entry and how many hold it."""
    own = entries.where("kind <> 'source' and title is not null and title <> ''")
    return own.groupBy("kind", "title").agg(F.min("id").alias("id"), F.count("*").alias("members"))


def members(entries: DataFrame) -> DataFrame:
    """(id, representative) of entries whose title others of their kind hold as well."""
    shared = classes(entries).where("members > 1").select("kind", "title", F.col("id").alias("representative"))
    return entries.select("id", "kind", "title").join(shared, ["kind", "title"]).select("id", "representative")


def _apart(m: int, n: int) -> int:
    """How many characters two near titles of these lengths differ by at most, as insertions and deletions; negative where none can be near."""
    by_ratio = int((m + n) * (1 - LEAST_RATIO) + 1e-9)
    by_edits = 2 * MOST_EDITS if abs(m - n) <= MOST_EDITS and max(m, n) >= LEAST_LENGTH else -1
    most = max(by_ratio, by_edits)
    return most if abs(m - n) <= most else -1


def _counts(titles: list[str]) -> np.ndarray:
    out = np.zeros((len(titles), COUNTED), dtype=np.int16)
    for row, title in zip(out, titles, strict=True):
        row += np.bincount(np.frombuffer(title.encode("utf-32-le"), dtype=np.uint32) % COUNTED, minlength=COUNTED).astype(np.int16)
    return out


def _bits(counts: np.ndarray) -> np.ndarray:
    """(2, titles): of each kind of character as many bits as it occurs, BITS at most; titles differ in no more bits than counts."""
    folded = counts.reshape(len(counts), 2, COUNTED // 2).sum(axis=1)
    unary = folded[:, :, None] > np.arange(BITS)
    return np.packbits(unary.reshape(len(counts), 2, -1), axis=2).view(np.uint64)[:, :, 0].T.copy()


def _candidates(counts: np.ndarray, bits: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of left and right whose counts allow them to be near, by pairs of lengths."""
    by_size = lambda rows: {int(n): rows[sizes[rows] == n] for n in np.unique(sizes[rows])}
    lefts, rights = by_size(left), by_size(right)
    for m, xs in lefts.items():
        for n, ys in rights.items():
            most = _apart(m, n)
            if most < 0 or same and n < m:
                continue
            for at in range(0, len(xs), 256):
                some = xs[at : at + 256]
                off = np.bitwise_count(bits[0, some][:, None] ^ bits[0, ys])
                off += np.bitwise_count(bits[1, some][:, None] ^ bits[1, ys])
                i, j = np.nonzero(off <= most)
                i, j = some[i], ys[j]
                if same and m == n:
                    i, j = i[i < j], j[i < j]
                for part in range(0, len(i), 65536):
                    a, b = i[part : part + 65536], j[part : part + 65536]
                    kept = np.abs(counts[a] - counts[b]).sum(axis=1) <= most
                    yield a[kept], b[kept]


def _near(frame: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of the titles of two blocks, or of one that meets itself."""
    kind, titles, ids = frame["kind"].iloc[0], frame["title"].tolist(), frame["id"].tolist()
    blocks, counts, sizes = frame["block"].to_numpy(), _counts(titles), np.array([len(t) for t in titles])
    first, same = frame["i"].iloc[0], frame["i"].iloc[0] == frame["j"].iloc[0]
    rows = np.arange(len(titles))
    left, right = (rows, rows) if same else (rows[blocks == first], rows[blocks != first])
    out = []
    for some, others in _candidates(counts, _bits(counts), sizes, left, right, same):
        for x, y in zip(some.tolist(), others.tolist(), strict=True):
            both, shared = len(titles[x]) + len(titles[y]), common_subsequence(titles[x], titles[y])
            if 2 * shared / both >= LEAST_RATIO or both - 2 * shared <= 2 * MOST_EDITS:
                out.append((kind, ids[x], titles[x], ids[y], titles[y], 2 * shared / both))
    return pd.DataFrame(out, columns=["kind", "a", "a_title", "b", "b_title", "ratio"])


def near_titles(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(kind, left_id, right_id, ratio, edits) of classes of near, unequal titles, left_id < right_id; edits is null beyond MOST_EDITS.
    A near pair of entries is one of their classes here, or one class in `members`. block: about how many titles a block has."""
    own = stored(classes(entries).select("kind", "title", "id"))
    blocks = own.groupBy("kind").agg(F.ceil(F.count("*") / block).alias("blocks"))  # a row a kind
    dealt = own.join(blocks, "kind").withColumn("block", F.pmod(F.xxhash64("title"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("kind", "title", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = dealt.groupBy("kind", "i", "j").applyInPandas(_near, _MET)
    edits = F.levenshtein("a_title", "b_title", MOST_EDITS)
    met = met.withColumn("edits", F.when((edits >= 0) & (F.greatest(F.length("a_title"), F.length("b_title")) >= LEAST_LENGTH), edits))
    met = met.where(F.col("edits").isNotNull() | (F.col("ratio") >= LEAST_RATIO))
    return met.select("kind", F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "ratio", "edits")


def duplicate_candidates(entries: DataFrame, named: int = NAMED) -> DataFrame:
    """Findings on entries of which others of their kind have the same or a near title; the message names the first of these.
    A class sends its first ids only, so large classes meet no others entry by entry."""
    first = lambda key, order: F.row_number().over(Window.partitionBy(*key).orderBy(order))
    alone = stored(entries.where("kind <> 'source' and title is not null and title <> ''").select("id", "kind", "title"))
    of = alone.join(classes(alone).select("kind", "title", F.col("id").alias("class")), ["kind", "title"]).select("id", "class")
    heads = of.withColumn("place", first(["class"], "id")).where(F.col("place") <= named + 1).select(F.col("class").alias("other"), F.col("id").alias("candidate"))
    near = stored(near_titles(alone)).select(F.col("left_id").alias("class"), F.col("right_id").alias("other"))
    near = near.unionByName(near.select(F.col("other").alias("class"), F.col("class").alias("other"))).unionByName(of.select("class", F.col("class").alias("other")).distinct())
    lists = near.join(heads, "other").withColumn("place", first(["class"], "candidate")).where(F.col("place") <= named + 1)
    lists = lists.groupBy("class").agg(F.array_sort(F.collect_list("candidate")).alias("all"))
    said = of.join(lists, "class").select("id", F.slice(F.filter("all", lambda c: c != F.col("id")), 1, named).alias("said")).where("size(said) > 0")
    return said.select(F.lit("duplicate_candidate").alias("rule_id"), F.lit("medium").alias("severity"), F.col("id").alias("target_id"), F.array_join("said", ",").alias("message"))
