"""Checks of texts, ids and terms: Unicode residuals, full-width characters, search terms, overlapping aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import CJK, PUNCTUATION, has_nfd_residual, to_nfc
from lorewright.plans import blocks
from lorewright.plans.lineage import stored

CODE = r"(?s)```.*?```|`[^`\n]*`"
LINK = r"\[[^\]]*\]\(([^)\s]+)"
ID = r"^ek_(src|note|dos|con|dec|view)_([0-7][0-9A-HJKMNP-TV-Z]{25})$"
#: The kind that an id's short name stands for.
KIND_OF = {"src": "source", "note": "note", "dos": "dossier", "con": "concept", "dec": "decision", "view": "view"}
LONGEST_TERM, FEWEST_TERMS = 40, 5


def id_kind(entry_id: Column) -> Column:
    """The kind that an id says; null for an id that is none."""
    short = F.regexp_extract(entry_id, ID, 1)
    return F.coalesce(*[F.when(short == s, F.lit(k)) for s, k in KIND_OF.items()])


def nfc_residuals(entries: DataFrame) -> DataFrame:
    """(id, rule_id, field, value): front matter, paths, relative Markdown links and source URLs that are not in NFC."""
    texts = [F.struct(F.lit("nfc_residual_in_frontmatter").alias("rule_id"), F.lit(f).alias("field"), F.array(F.col(f)).alias("v")) for f in ("title", "domain")]
    texts += [F.struct(F.lit("nfc_residual_in_frontmatter").alias("rule_id"), F.lit(f).alias("field"), F.col(f).alias("v")) for f in ("aliases", "tags", "search_terms")]
    texts.append(F.struct(F.lit("nfc_residual_in_path").alias("rule_id"), F.lit("file_path").alias("field"), F.array("file_path").alias("v")))
    links = F.filter(F.regexp_extract_all("body", F.lit(LINK), F.lit(1)), lambda x: ~x.rlike("^(https?://|mailto:|#)"))
    texts.append(F.struct(F.lit("nfc_residual_in_markdown_link").alias("rule_id"), F.lit("body").alias("field"), links.alias("v")))
    texts.append(F.struct(F.lit("nfc_residual_in_source_url").alias("rule_id"), F.lit("source_url").alias("field"), F.array("source_url").alias("v")))
    rows = entries.select("id", F.explode(F.array(*texts)).alias("t")).select("id", "t.rule_id", "t.field", F.explode("t.v").alias("value"))
    return rows.where(has_nfd_residual(F.col("value")))


def without_code(body: Column) -> Column:
    """The body, code blocks and code spans left out."""
    return F.regexp_replace(F.coalesce(body, F.lit("")), CODE, " ")


def fullwidth(entries: DataFrame, raw: str | None = None) -> DataFrame:
    """(id, part, char): the first full-width character of an entry's front matter (raw, a column; the punctuation that has
    a half-width form) and of its body outside code (full-width spaces, letters and digits)."""
    body = F.regexp_extract(without_code(F.col("body")), r"([\x{3000}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}])", 1)
    parts = [F.struct(F.lit("body").alias("part"), body.alias("char"))]
    if raw:
        parts.append(F.struct(F.lit("fm").alias("part"), F.regexp_extract(raw, f"([{PUNCTUATION[0]}])", 1).alias("char")))
    return entries.select("id", F.explode(F.array(*parts)).alias("p")).select("id", "p.part", "p.char").where("char <> ''")


def term_problems(entries: DataFrame) -> DataFrame:
    """(id, problem): what is wrong with an entry's search terms. An empty term stands for a missing English one; aliases are
    terms that neither hold the title nor stand in it."""
    rows = entries.select("id", to_nfc(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("search_terms", F.array().cast("array<string>")).alias("terms"))
    terms, title = F.col("terms"), F.col("title")
    has = lambda test: F.exists(terms, test)
    named = lambda name, bad: F.when(bad, F.lit(name))
    said = F.filter(terms, lambda x: x != "")
    alias = has(lambda x: (x != "") & (F.instr(title, x) == 0) & (F.instr(x, title) == 0))
    problems = F.array_compact(F.array(
        named("too_few", F.size(terms) < FEWEST_TERMS), named("no_cjk", ~has(lambda x: x.rlike(f"[{CJK}]"))), named("no_english", ~has(lambda x: (x == "") | x.rlike("[A-Za-z]"))),
        named("no_alias", ~alias), named("too_long", has(lambda x: F.length(x) > LONGEST_TERM)), named("blank", has(lambda x: (x != "") & (F.trim(x) == ""))),
        named("many_empty", F.size(F.filter(terms, lambda x: x == "")) > 1), named("repeated", F.size(F.array_distinct(said)) < F.size(said)),
    ))
    return rows.select("id", F.explode(problems).alias("problem"))


def cross_language_aliases(entries: DataFrame, least: int = 1, block: int = blocks.BLOCK) -> DataFrame:
    """(left_id, right_id, shared): pairs of entries that have aliases in common and, in all their aliases, both CJK and
    English ones; shared counts them. A pair is made under the first alias that both hold, and counts the later ones there, so no
    pair is shuffled. Of an alias's holders those meet as one that have the same further aliases, where only those count that
    another holder of it has too; they are dealt into blocks (`plans/blocks.py`), so an alias of very many holders is no one task.
    Pairs are the result, so they are as many as there are."""
    own = entries.where("status <> 'archived'").select("id", F.array_sort(F.array_distinct(F.filter("aliases", lambda x: x.isNotNull()))).alias("aliases")).where("size(aliases) > 0")
    traits = lambda p: F.exists("aliases", lambda x: x.rlike(p))
    own = stored(own.select("id", "aliases", traits(f"[{CJK}]").alias("cjk"), traits("[A-Za-z]").alias("english")))
    posted = own.select("id", "cjk", "english", F.explode("aliases").alias("alias"))
    facts = posted.groupBy("alias").agg(F.count("*").alias("n"), F.bool_or("cjk").alias("any_cjk"), F.bool_or("english").alias("any_english"))
    posted = posted.join(facts.where("n > 1 and any_cjk and any_english").select("alias"), "alias")
    # (id, a, b): two aliases of an entry that another entry has too, in their order
    twos = own.select("id", "aliases", F.posexplode("aliases").alias("at", "a")).select("id", "a", F.explode(F.slice("aliases", F.col("at") + 2, F.size("aliases"))).alias("b"))
    twos = twos.join(twos.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), ["a", "b"])
    void = F.lit(None).cast("string")
    beside = twos.select("id", F.col("a").alias("alias"), void.alias("before"), F.col("b").alias("after")).unionAll(twos.select("id", F.col("b").alias("alias"), F.col("a").alias("before"), void.alias("after")))
    beside = beside.groupBy("id", "alias").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in ("before", "after")])
    nothing = F.array().cast("array<string>")
    held = stored(posted.join(beside, ["id", "alias"], "left").withColumns({c: F.coalesce(c, nothing) for c in ("before", "after")}))
    met = blocks.met(stored(blocks.alike(held, block)), ["alias"], block).where("(cjk_l or cjk_r) and (english_l or english_r)").where(blocks.apart("before_l", "before_r"))
    none = lambda a, b: (F.size(a) == 0) | (F.size(b) == 0)
    shared = 1 + F.when(none("after_l", "after_r"), 0).otherwise(F.size(F.array_intersect("after_l", "after_r")))
    found = met.withColumn("shared", shared.cast("long"))
    return blocks.pairs(found if least <= 1 else found.where(F.col("shared") >= least), "shared")


def fallback_summary(log: DataFrame, now_epoch: int, least: int = 50, samples: int = 5) -> DataFrame:
    """(n, tokens) of a tokenizer's fallbacks (ts_epoch, token) of the last day, where there are `least`; five samples."""
    recent = log.where(F.col("ts_epoch") >= now_epoch - 86400)
    first = recent.where("token is not null").orderBy("ts_epoch", "token").limit(samples).agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return recent.agg(F.count("*").alias("n")).where(F.col("n") >= least).join(first, F.lit(True))  # one row each
