"""Words of Chinese text: the best path through the lattice of a dictionary's words, by frequency.

A word weighs round(10**6 * ln(frequency / total)), an unknown character as a word of frequency 1. Weights are integers, so
that every engine finds the same path; of equal paths the one whose next word is longer is taken, from the left. Characters that
no word of the dictionary covers are taken as overlapping pairs, a single one as itself."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import CJK
from lorewright.plans.lineage import stored

#: The frequency of words that come from the entries themselves (fixed value).
FREQUENCY = 5
#: Words that tasks are sent; of larger dictionaries each text is sent those that occur in it.
MOST_WORDS = 500_000
_HAN = "一-鿿㐀-䶿豈-﫿\U00020000-\U0002ebef"
#: Han runs, and runs of other letters, digits and dashes.
PIECES = re.compile(f"([{_HAN}]+)|((?:(?![{_HAN}])[^\\W_]|-)+)")
_ASCII = re.compile("[A-Za-z0-9-]+")
_RUNS = f"[{CJK}]+"


class Dictionary(NamedTuple):
    """words: (word, frequency), each word once, of at least two Han characters; total and longest are facts of all of them."""

    words: DataFrame
    count: int
    total: int
    longest: int

    def among(self, text: str) -> dict[str, int]:
        """The frequencies of the words that occur in a short text (a query)."""
        parts = {run[i:j] for run in re.findall(f"[{_HAN}]+", text) for i in range(len(run)) for j in range(i + 2, min(len(run), i + self.longest) + 1)}
        return {r.word: r.frequency for r in self.words.where(F.col("word").isin(*parts)).collect()} if parts else {}


def dictionary(entries: DataFrame, more: DataFrame | None = None) -> Dictionary:
    """Aliases and tags of the entries, and more words (word, frequency); a word counts with its highest frequency."""
    listed = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>")))
    words = entries.select(F.explode(F.transform(listed, lambda x: F.trim(x))).alias("word"), F.lit(FREQUENCY).alias("frequency"))
    words = words if more is None else words.unionByName(more.select("word", F.col("frequency").cast("int").alias("frequency")))
    return of_words(words.where(F.col("word").rlike(f"^[{CJK}]{{2,}}$")).groupBy("word").agg(F.max("frequency").alias("frequency")))


def of_words(words: DataFrame) -> Dictionary:
    words = stored(words)  # read for its facts, for tasks and for queries
    facts = words.agg(F.count("*"), F.sum("frequency"), F.max(F.length("word"))).first()
    return Dictionary(words, facts[0], facts[1] or 0, facts[2] or 1)


def weigh(frequency: int, total: int) -> int:
    return round(1e6 * math.log(frequency / total)) if total > 0 else 0


def best_path(run: str, words: dict[str, int], total: int, longest: int) -> list[str]:
    """The words of a Han run."""
    n, unknown = len(run), weigh(1, total)
    best, step = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        best[i] = unknown + best[i + 1]
        for m in range(2, min(longest, n - i) + 1):
            found = words.get(run[i : i + m])
            if found is not None and weigh(found, total) + best[i + m] >= best[i]:
                best[i], step[i] = weigh(found, total) + best[i + m], m
    out, loose, i = [], "", 0
    while i < n:
        if step[i] == 1:
            loose += run[i]
        else:
            out += _pairs(loose) + [run[i : i + step[i]]]
            loose = ""
        i += step[i]
    return out + _pairs(loose)


def _pairs(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(len(run) - 1)] or ([run] if run else [])


def tokens(text: str, words: dict[str, int], total: int, longest: int) -> list[str]:
    """Words of Han runs, and other runs of letters, digits and dashes in lower case."""
    return [t for m in PIECES.finditer(text) for t in (best_path(m[1], words, total, longest) if m[1] else [m[2].lower()])]


def count(text: str, cut: Callable[[str], list[str]]) -> int:
    """How many tokens a text has; cut gives them, and ASCII texts need no segmenter."""
    return len(_ASCII.findall(text)) if text.isascii() else len(cut(text))


def cutter(known: Dictionary, most: int = MOST_WORDS) -> Callable[[str], list[str]] | None:
    """`tokens` of a text as a function that tasks can be sent, with the words as one broadcast value; None where they are more than `most`."""
    if known.count > most:
        return None
    total, longest = known.total, known.longest
    held = known.words.sparkSession.sparkContext.broadcast({r.word: r.frequency for r in known.words.limit(most).collect()})
    return lambda text: tokens(text, held.value, total, longest)


def tokenised(texts: DataFrame, known: Dictionary, most: int = MOST_WORDS) -> DataFrame:
    """texts (key, text) as (key, tokens). Up to `most` words go to every task as one broadcast value; of more, each text gets
    those that it holds, by a join of its Han runs' parts with the dictionary."""
    total, longest = known.total, known.longest
    if known.count <= most:
        held = texts.sparkSession.sparkContext.broadcast({r.word: r.frequency for r in known.words.limit(most).collect()})

        @F.pandas_udf("array<string>")
        def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(lambda s: tokens(s or "", held.value, total, longest))

        return texts.select("key", split("text").alias("tokens"))

    @F.pandas_udf("array<string>")
    def split_by_own(batch: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([tokens(s or "", dict(w), total, longest) for s, w in zip(batch, own, strict=True)], dtype=object)

    runs = texts.select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_RUNS), F.lit(0)))).alias("run")).where(F.length("run") > 1)
    starts = runs.select("key", "run", F.explode(F.sequence(F.lit(1), F.length("run") - 1)).alias("i"))
    lengths = F.sequence(F.lit(2), F.least(F.lit(longest), F.length("run") - F.col("i") + 1))
    parts = starts.select("key", F.explode(F.transform(lengths, lambda m: F.substring(F.col("run"), F.col("i"), m))).alias("word")).distinct()
    own = parts.join(known.words, "word").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "frequency"))).alias("own"))
    met = texts.join(own, "key", "left").withColumn("own", F.coalesce("own", F.create_map().cast("map<string,int>")))
    return met.select("key", split_by_own("text", "own").alias("tokens"))
