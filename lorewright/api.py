"""The knowledge base: one facade over snapshot tables. Reads are DataFrames; a mutation validates one entry on the driver
and merges it by key into a new version."""

from __future__ import annotations

import secrets
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.errors import BodyTooLong, BodyTooShort, ConflictError, NotFoundError, ValidationError
from lorewright.functions import segment, text
from lorewright.model import ENTRY_SCHEMA, FINDING_SCHEMA, FRESHNESS, KINDS, LEAST_BODY, MOST_BODY, ORIGINS, QUEUE_SCHEMA, RELATION_SCHEMA, RELATION_TYPES, REVIEW_DAYS, STATUSES
from lorewright.operators import analytics, checks, dense, filters, fulltext, graph, lists, metrics, rules, search
from lorewright.plans.lineage import cut
from lorewright.plans.shipping import ship
from lorewright.sources import logs, markdown
from lorewright.sources.files import FileChanges
from lorewright.sources.snapshots import Snapshots

ACCESS_SCHEMA = "entry_id string, op string, accessed_at timestamp"
METRICS_SCHEMA = "entry_id string, evidence_strength double, drift_score double, compression_ratio long, action_relevance long, retrieval_heat double, authority_score double, updated_at timestamp"
DOMAIN_SCHEMA = "domain string"
WATCH_SCHEMA = "id string, source_type string, target string, cursor string, last_checked_at timestamp, consecutive_404_count int"
_SHORT = {"source": "src", "note": "note", "dossier": "dos", "concept": "con", "decision": "dec", "view": "view"}
_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_FIXED = ("id", "kind", "file_path", "created_at")
#: Promotions: from, to.
PROMOTIONS = {("note", "concept"), ("note", "dossier"), ("dossier", "concept"), ("concept", "decision")}
CHANNELS = {"high": "push", "medium": "digest", "warning": "log", "low": "log"}
#: Mutations that `apply` takes, and the tables that they change.
MUTATIONS = ("ingest", "update", "touch", "delete", "rename", "link", "unlink", "promote", "add_domain", "migrate_domain")
_CHANGED = {"entries": ENTRY_SCHEMA, "domains": DOMAIN_SCHEMA, "unindexed": "id string"}
#: Messages that a queue item's details spell out.
MESSAGES = 20
POLICIES = ("strict", "merge_suggest", "allow")


def ulid(now: float | None = None) -> str:
    """48 bits of milliseconds and 80 random bits in Crockford's base 32."""
    number = (int((time.time() if now is None else now) * 1000) << 80) | secrets.randbits(80)
    return "".join(_CROCKFORD[number >> shift & 31] for shift in range(125, -1, -5))


class KnowledgeBase:
    entries_schema = ENTRY_SCHEMA

    def __init__(self, spark: SparkSession, root: str, today: date | None = None):
        self.spark, self.root, self.tables = spark, root, Snapshots(spark, f"{root}/.tables")
        self._today = today
        self._batch: FileChanges | None = None
        ship(spark)

    # --- tables
    @property
    def today(self) -> date:
        return self._today or datetime.now(UTC).date()

    def entries(self) -> DataFrame:
        return self.tables.read("entries", ENTRY_SCHEMA)

    def relations(self) -> DataFrame:
        return markdown.relations(self.entries()).select("source_id", "target_id", "type", "origin")

    def access_log(self) -> DataFrame:
        return self.tables.read("access_log", ACCESS_SCHEMA)

    def queue(self) -> DataFrame:
        return self.tables.read("queue", QUEUE_SCHEMA)

    def metrics(self) -> DataFrame:
        return self.tables.read("metrics", METRICS_SCHEMA)

    def domains(self) -> DataFrame:
        return analytics.domain_list(self.entries(), self.tables.read("domains", DOMAIN_SCHEMA))

    # --- batch
    def build(self) -> DataFrame:
        """Rebuild the entries from the Markdown files; gives the files that were set aside."""
        FileChanges.recover(self.spark, self.root)
        good, bad = markdown.entries(self.spark, self.root)
        twice = good.groupBy("id").count().where("count > 1")
        if not twice.isEmpty():
            raise ConflictError("several files hold one id")
        self.tables.write("entries", good, ["id"])
        self.reindex()
        return bad

    def reindex(self) -> None:
        """Write the search indexes anew: postings in order of index and term, so that a query reads few row groups, lengths, their
        totals, the number of fields that hold each term, and the segmenter's dictionary."""
        entries = self.entries()
        self.tables.write("words", segment.dictionary(entries).words)
        rows = fulltext.postings(entries, self._dictionary())
        self.tables.write("postings", rows.repartitionByRange("index", "term").sortWithinPartitions("index", "term", "id"))
        rows = self.tables.read("postings", fulltext.POSTINGS)
        self.tables.write("vocabulary", fulltext.vocabulary(rows).repartitionByRange("index", "term").sortWithinPartitions("index", "term"))
        self.tables.write("sizes", fulltext.sizes(rows))
        totals = fulltext.totals(self.tables.read("sizes", fulltext.SIZES), entries.count())
        self.tables.write("totals", self.spark.createDataFrame([(k, *v) for k, v in totals.items()], fulltext.TOTALS))
        self.tables.write("unindexed", self.spark.createDataFrame([], "id string"))

    def _dictionary(self) -> segment.Dictionary:
        return segment.of_words(self.tables.read("words", "word string, frequency int"))

    def index(self) -> fulltext.Index | None:
        """The kept indexes, but for entries changed since, whose are worked out; None before a `reindex`. Totals are the kept ones, less
        what the changed entries had and with what they have."""
        if self.tables.version("totals") is None:
            return None
        known, changed = self._dictionary(), self.tables.read("unindexed", "id string")
        kept = [self.tables.read(t, s) for t, s in (("postings", fulltext.POSTINGS), ("sizes", fulltext.SIZES), ("vocabulary", fulltext.VOCABULARY))]
        totals = {r["index"]: (r.docs, r.tokens) for r in self.tables.read("totals", fulltext.TOTALS).collect()}  # a row an index
        if changed.isEmpty():
            return fulltext.Index(kept[0], kept[1], totals, kept[2], known)
        rows = self.entries().join(changed, "id", "left_semi")
        fresh = cut(fulltext.postings(rows, known))
        lengths = fulltext.sizes(fresh)
        was, now = (fulltext.totals(x, 0) for x in (kept[1].join(changed, "id", "left_semi"), lengths))
        docs = self.entries().count()
        totals = {k: (docs, n - was[k][1] + now[k][1]) for k, (_, n) in totals.items()}
        out = [k.join(changed, "id", "left_anti").select(*k.columns).unionByName(f) for k, f in zip(kept, (fresh, lengths), strict=False)]
        return fulltext.Index(*out, totals, kept[2], known)

    def recompute(self) -> None:
        """All metrics and authority scores."""
        entries, edges = self.entries(), self.relations()
        rank = graph.pagerank(entries, edges).select("id", F.col("rank").alias("authority_score"))
        rows = metrics.entry_metrics(entries, edges, self.access_log(), self.today.isoformat()).join(rank, "id", "left")
        rows = rows.select(F.col("id").alias("entry_id"), "evidence_strength", "drift_score", "compression_ratio", "action_relevance", "retrieval_heat", F.coalesce("authority_score", F.lit(0.0)).alias("authority_score"), F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp").alias("updated_at"))
        self.tables.write("metrics", cut(rows), ["entry_id"])

    # --- reads
    def get(self, entry_id: str, log: bool = True) -> dict:
        row = self.entries().where(F.col("id") == entry_id).first()
        if row is None:
            raise NotFoundError(entry_id)
        if log:
            now = datetime.now(UTC).replace(tzinfo=None)
            self.tables.append("access_log", self.spark.createDataFrame([(entry_id, "get", now)], ACCESS_SCHEMA))
        return row.asDict(recursive=True)

    def search(
        self, query: str, kinds: list[str] | None = None, where: dict[str, object] | None = None, backends: list[str] | None = None, limit: int = 20, graph_expansion: bool = True,
        archived: bool = False, embedder: dense.Embedder | None = None,
    ) -> DataFrame:
        """(id, score, backends, snippet), best first; vectors count where an embedder is given and some are stored."""
        authority = self.metrics().select(F.col("entry_id").alias("id"), F.col("authority_score").alias("authority"))
        return search.search(self.entries(), self.relations(), authority, query, kinds, where, backends, limit, graph_expansion, archived, self.index(), self._dense(embedder))

    def _dense(self, embedder: dense.Embedder | None) -> Callable[[str, int], DataFrame] | None:
        """The vector route; an embedder that fails gives no hits and a line in the log of errors."""
        store = self.tables.read("dense", dense.STORE_SCHEMA)
        if not dense.enabled(store, embedder):
            return None

        def hits(query: str, limit: int) -> DataFrame:
            try:
                return dense.dense_hits(store, query, limit, embedder)
            except Exception as e:  # an embedder may fail in any way; the other routes still answer
                logs.dense_error(self.spark, self.root, "dense_search_error", f"{type(e).__name__}: {e}")
                return self.spark.createDataFrame([], "id string, score double")

        return hits

    def related(self, entry_id: str, depth: int = 1) -> DataFrame:
        return graph.related(self.relations(), self.entries(), self.entries().where(F.col("id") == entry_id).select("id"), depth).select("id", "layer")

    def stats(self, by: str = "kind") -> DataFrame:
        if by not in ("kind", "status", "freshness", "domain"):
            raise ValidationError(f"stats by {by}")
        return analytics.counts_by(self.entries(), by)

    def review(self, overdue_only: bool = True) -> DataFrame:
        due = filters.review_due(self.entries(), self.today.isoformat() if overdue_only else "9999-12-31")
        return due.select("id", "title", "review_due_at")

    # --- validation
    def _checked(self, entry: dict) -> dict:
        if entry["kind"] not in KINDS or entry["status"] not in STATUSES or entry["freshness"] not in FRESHNESS:
            raise ValidationError("kind, status or freshness is unknown")
        if not (entry.get("title") or "").strip():
            raise ValidationError("title is missing")
        body = entry.get("body") or ""
        if len(body.encode()) > MOST_BODY:
            raise BodyTooLong("body is too long", {"length": len(body.encode()), "maximum": MOST_BODY})
        if entry["kind"] != "source" and len(body.strip()) < LEAST_BODY:
            raise BodyTooShort("body is too short", {"length": len(body.strip()), "minimum": LEAST_BODY})
        if entry["kind"] == "source" and not str(entry.get("source_url")).startswith(("http://", "https://", "knowledge://")):
            raise ValidationError("source_url")
        row = self._frame([entry])
        problems = [r.problem for r in checks.term_problems(row).select("problem").collect()]  # of one entry
        if problems:
            raise ValidationError(f"search_terms: {', '.join(problems)}")
        slug = row.select(text.slug(F.lit(entry["title"])).alias("s")).first().s
        entry["slug"] = entry.get("slug") or slug
        if not entry["slug"]:
            raise ValidationError("the title leaves no slug")
        return entry

    def _frame(self, rows: list[dict]) -> DataFrame:
        names = [c.split()[0] for c in ENTRY_SCHEMA.replace("\n", " ").split(", ") if c.strip()]
        schema = self.spark.createDataFrame([], ENTRY_SCHEMA).schema
        return self.spark.createDataFrame([tuple(r.get(n) for n in (names if len(names) == len(schema) else schema.names)) for r in rows], schema)

    def _references(self, entry: dict) -> None:
        wanted = {*(entry.get("source_refs") or []), *(entry.get("evidence_refs") or []), *[r["target"] for r in entry.get("relations") or []], *([entry["superseded_by"]] if entry["kind"] == "decision" and entry.get("superseded_by") else [])} - {entry["id"]}
        known = {r.id for r in self.entries().where(F.col("id").isin(*wanted)).select("id").collect()} if wanted else set()  # ids of one entry's references
        if wanted - known:
            raise NotFoundError(f"references: {sorted(wanted - known)}")

    def conflicts(self, entry: dict) -> list[str]:
        """Ids of entries of the kind whose alias or title is taken, or whose title is nearly the same."""
        if entry["kind"] == "source":
            return []
        others = self.entries().where((F.col("kind") == entry["kind"]) & (F.col("id") != entry["id"]))
        names = [entry["title"], *(entry.get("aliases") or [])]
        title = F.lit(entry["title"])
        near = (F.greatest(F.length("title"), F.length(title)) >= 4) & (F.levenshtein("title", title, 2) >= 0)
        band = 2 * F.least(F.length("title"), F.length(title)) >= 0.85 * (F.length("title") + F.length(title))
        same = F.arrays_overlap("aliases", F.array(*[F.lit(n) for n in names])) | near | (F.when(band, text.similarity_ratio("title", title)) >= 0.85)
        return [r.id for r in others.where(same).select("id").orderBy("id").collect()]  # entries nearly of one name

    # --- mutations
    def ingest(self, kind: str, payload: dict, policy: str = "strict") -> dict:
        if policy not in POLICIES:
            raise ValidationError(f"policy: {policy}")
        fields = set(self.spark.createDataFrame([], ENTRY_SCHEMA).columns)
        if set(payload) - fields or set(payload) & {"id", "kind", "file_path"}:
            raise ValidationError(f"unknown or fixed fields: {sorted(set(payload) - fields | set(payload) & {'id', 'kind', 'file_path'})}")
        base = {"status": "active", "freshness": "watch", "aliases": [], "tags": [], "search_terms": [], "relations": [], "source_refs": [], "evidence_refs": [], "created_at": self.today, "updated_at": self.today}
        entry = base | payload | {"id": f"ek_{_SHORT.get(kind, 'x')}_{ulid()}", "kind": kind}
        entry["domain"] = payload.get("domain") or self._domain(entry["tags"])
        if kind == "dossier":
            entry["reviewed_at"] = entry.get("reviewed_at") or self.today
            entry["review_due_at"] = entry.get("review_due_at") or entry["reviewed_at"] + timedelta(days=REVIEW_DAYS[entry["freshness"]])
        if kind == "concept":
            refs = len(set(entry["evidence_refs"]))
            entry["evidence_status"] = "solid" if refs >= 2 else "partial" if refs else "weak"
        if kind == "decision":
            entry["decision_status"] = entry.get("decision_status") or "active"
        entry = self._checked(entry)
        self._references(entry)
        met = self.conflicts(entry)
        if met and policy == "strict":
            raise ConflictError(f"conflicts with {met}")
        entry["file_path"] = self._frame([entry]).select(filters.path_of(F.col("kind"), F.col("domain"), F.col("slug"), F.col("created_at")).alias("p")).first().p
        if not self.entries().where((F.col("file_path") == entry["file_path"]) & (F.col("id") != entry["id"])).isEmpty():
            raise ConflictError(entry["file_path"])
        self._put([entry])
        return entry | {"candidates": met}

    def _domain(self, tags: list[str]) -> str:
        known = {r.domain for r in self.tables.read("domains", DOMAIN_SCHEMA).where(F.col("domain").isin(*tags)).collect()} if tags else set()
        return next((t for t in tags if t in known), analytics.FALLBACK)

    @contextmanager
    def _changes(self) -> Iterator[FileChanges]:
        """File changes that are taken back if the block fails; within `apply` the whole batch's."""
        if self._batch is not None:
            yield self._batch
            return
        FileChanges.recover(self.spark, self.root)
        changes = FileChanges(self.spark, self.root)
        try:
            yield changes
        except BaseException:
            changes.undo()
            raise
        changes.done()

    def _unindex(self, ids: DataFrame) -> None:
        """Before a change: a search works these entries' postings out anew, whether or not the change succeeds."""
        if self.tables.version("sizes") is not None:
            self.tables.merge("unindexed", "id string", ids.select("id").distinct(), ["id"])

    def put(self, rows: DataFrame) -> None:
        """Upsert entries: their files first, which `build` goes by, then the table. Entries whose path changed leave the old
        file. Rows pass the driver one partition at a time, as files are renamed there."""
        rows = graph.cut(rows.select(*self.entries().columns))
        taken = rows.select(F.col("file_path").alias("old_path"), F.lit(True).alias("taken")).distinct()
        before = self.entries().select("id", F.col("file_path").alias("old_path")).join(taken, "old_path", "left")
        moved = rows.join(before, "id", "left").select(*rows.columns, "old_path", "taken")
        with self._changes() as changes:
            self._unindex(rows)
            for row in moved.toLocalIterator():
                entry = row.asDict(recursive=True)
                old, taken_over = entry.pop("old_path"), entry.pop("taken")
                if entry["file_path"]:
                    changes.write(entry["file_path"], markdown.rendered(entry, entry["body"] or ""))
                if old and not taken_over:
                    changes.remove(old)
            self.tables.merge("entries", ENTRY_SCHEMA, rows, ["id"])

    def _put(self, rows: list[dict]) -> None:
        self.put(self._frame(rows))

    def apply(self, operations: list[tuple[str, dict]]) -> list:
        """Mutations as (name, arguments), all or none; entries are made before anything else happens. Gives the results in the
        order asked. Where one fails, files and tables are as before, and its error is raised."""
        unknown = sorted({name for name, _ in operations} - set(MUTATIONS))
        if unknown:
            raise ValidationError(f"mutations: {unknown}")
        if self._batch is not None:
            raise ConflictError("a batch is under way")
        before = {t: self.tables.version(t) for t in _CHANGED}
        results: dict[int, object] = {}
        FileChanges.recover(self.spark, self.root)
        self._batch = FileChanges(self.spark, self.root)
        try:
            for n in sorted(range(len(operations)), key=lambda n: operations[n][0] != "ingest"):
                name, arguments = operations[n]
                results[n] = getattr(self, name)(**arguments)
        except BaseException:
            self._batch.undo()
            for table, version in before.items():
                if self.tables.version(table) != version:
                    self.tables.restore(table, version) if version else self.tables.write(table, self.spark.createDataFrame([], _CHANGED[table]))
            raise
        else:
            self._batch.done()
        finally:
            self._batch = None
        return [results[n] for n in range(len(operations))]

    def update(self, entry_id: str, changes: dict) -> dict:
        if set(changes) & set(_FIXED):
            raise ValidationError(f"fixed fields: {sorted(set(changes) & set(_FIXED))}")
        entry = self.get(entry_id, log=False)
        if "slug" in changes and entry["kind"] in ("concept", "dossier", "decision") and changes["slug"] != entry["slug"]:
            raise ValidationError("the slug of this kind is stable; rename it")
        if "domain" in changes and changes["domain"] != entry["domain"]:
            raise ValidationError("domains change by migration")
        before = entry["status"]
        entry = self._checked(entry | changes | {"updated_at": self.today})
        self._references(entry)
        self._put([entry])
        if entry["status"] != before:
            logs.status_transition(self.spark, self.root, entry_id, before, entry["status"], datetime.now(UTC).isoformat(timespec="seconds"))
        return entry

    def touch(self, entry_id: str) -> dict:
        entry = self.get(entry_id, log=False) | {"updated_at": self.today}
        self._put([entry])
        return entry

    def delete(self, entry_id: str) -> None:
        path, gone = self.get(entry_id, log=False)["file_path"], self.spark.createDataFrame([(entry_id,)], "id string")
        with self._changes() as changes:
            self._unindex(gone)
            if path:
                changes.remove(path)
            self.tables.delete("entries", ENTRY_SCHEMA, gone, ["id"])

    def rename(self, entry_id: str, slug: str) -> dict:
        """Change a stable slug; links to the old path in other bodies follow it."""
        entry = self.get(entry_id, log=False)
        if entry["kind"] not in ("concept", "dossier", "decision"):
            raise ValidationError(f"a {entry['kind']} isn't renamed")
        if self.spark.range(1).select(text.slug(F.lit(slug)).alias("s")).first().s != slug:
            raise ValidationError(f"slug: {slug}")
        old, new = entry["file_path"], entry["file_path"].rsplit("/", 1)[0] + f"/{slug}.md"
        if not self.entries().where(F.col("file_path") == new).isEmpty():
            raise ConflictError(new)
        moved = {old: new}

        @F.pandas_udf("string")
        def rewritten(bodies: pd.Series, paths: pd.Series) -> pd.Series:
            return pd.Series([b if b is None else text.rewrite_links(b, p, p, moved) for b, p in zip(bodies, paths, strict=True)])

        linked = self.entries().where((F.col("id") != entry_id) & F.col("body").contains(old.rsplit("/", 1)[1]))
        rows = linked.withColumn("body", rewritten("body", "file_path")).unionByName(self._frame([entry | {"slug": slug, "file_path": new, "updated_at": self.today}]))
        self.put(rows)
        return self.get(entry_id, log=False)

    def link(self, source_id: str, target_id: str, rel_type: str, origin: str = "confirmed") -> dict:
        if rel_type not in RELATION_TYPES[:8] or origin not in ORIGINS:
            raise ValidationError(f"relation: {rel_type}, {origin}")
        self.get(target_id, log=False)
        entry = self.get(source_id, log=False)
        kept = [r for r in entry["relations"] or [] if (r["target"], r["type"]) != (target_id, rel_type)]
        self._put([entry | {"relations": [*kept, {"target": target_id, "type": rel_type, "source": origin}], "updated_at": self.today}])
        return {"source_id": source_id, "target_id": target_id, "type": rel_type, "origin": origin}

    def unlink(self, source_id: str, target_id: str) -> None:
        """Drop all stated relations to the target; references by fields are refused."""
        entry = self.get(source_id, log=False)
        if target_id in (entry["source_refs"] or []) + (entry["evidence_refs"] or []) + [entry["superseded_by"]]:
            raise ValidationError("a reference field holds the target")
        kept = [r for r in entry["relations"] or [] if r["target"] != target_id]
        if len(kept) == len(entry["relations"] or []):
            raise NotFoundError(f"{source_id} -> {target_id}")
        self._put([entry | {"relations": kept, "updated_at": self.today}])

    def promote(self, entry_id: str, target_kind: str, freshness: str | None = None) -> dict:
        entry = self.get(entry_id, log=False)
        if (entry["kind"], target_kind) not in PROMOTIONS:
            raise ValidationError(f"{entry['kind']} to {target_kind}")
        if entry["kind"] == "dossier" and (entry["reviewed_at"] is None or (self.today - entry["reviewed_at"]).days > 30):
            raise ValidationError("the dossier wasn't reviewed within 30 days")
        refs = (entry["source_refs"] if entry["kind"] == "note" else entry["evidence_refs"]) or []
        payload = {k: entry[k] for k in ("title", "search_terms", "tags", "aliases", "confidence", "body", "domain")}
        payload |= {"evidence_refs": [*refs, *([entry_id] if entry["kind"] == "concept" else [])], "freshness": freshness or entry["freshness"], "relations": [{"target": entry_id, "type": "supersedes" if entry["kind"] == "dossier" else "derived_from", "source": "confirmed"}]}
        made = self.ingest(target_kind, payload, "allow")
        if entry["kind"] == "concept":
            self.link(entry_id, made["id"], "applied_in")
        return made

    def add_domain(self, name: str) -> None:
        self.tables.merge("domains", DOMAIN_SCHEMA, self.spark.createDataFrame([(name,)], DOMAIN_SCHEMA), ["domain"])

    def migrate_domain(self, old: str, new: str) -> int:
        moved = self.entries().where(F.col("domain") == old)
        count = moved.count()
        rows = moved.withColumn("domain", F.lit(new)).withColumn("file_path", filters.path_of(F.col("kind"), F.col("domain"), F.col("slug"), F.col("created_at")))
        if count:
            self.put(rows)
        return count

    # --- rules
    def diagnose(self) -> DataFrame:
        """Findings of all diagnose rules."""
        entries, edges, today = self.entries(), self.relations(), self.today.isoformat()
        reached = graph.cut(graph.reachable_sources(entries, edges))
        facts = graph.cut(metrics.evidence(entries, edges, today, reached))
        heat, relevance = metrics.retrieval_heat(self.access_log(), today), metrics.action_relevance(entries, edges)
        return self._findings({
            "source_reachability": lambda: rules.source_reachability(entries, reached), "view_as_evidence": lambda: rules.view_as_evidence(entries, edges),
            "source_context": lambda: rules.source_context(entries, edges), "dossier_outdated": lambda: rules.dossier_outdated(entries, facts, reached),
            "evidence_singular": lambda: rules.evidence_singular(entries, edges, facts), "pseudo_stable": lambda: rules.evidence_singular(entries, edges, facts, True),
            "fossil_concept": lambda: rules.fossil_concept(entries, facts, relevance), "monoculture": lambda: rules.monoculture(entries, facts),
            "supersedes_cycle": lambda: rules.supersedes_cycle(edges), "demote": lambda: rules.demote(entries, edges, facts), "merge": lambda: rules.merge(entries, edges),
            "retract": lambda: rules.retract(entries, edges, facts), "premise_shaken": lambda: rules.premise_shaken(entries, edges, facts, heat),
            "crystallize": lambda: rules.crystallize(entries, edges), "internal_split": lambda: rules.internal_split(entries, edges),
            "divergence": lambda: rules.divergence(entries, facts, heat), "promotion_signal": lambda: rules.promotion_signal(entries, edges, facts, relevance),
        })

    def doctor(self) -> DataFrame:
        """Findings of the integrity rules."""
        entries, edges = self.entries(), self.relations()
        plain = lambda df, rule, severity, target, message: df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(target).alias("target_id"), F.col(message).cast("string").alias("message"))
        twice = entries.groupBy("id").agg(F.array_join(F.collect_list("file_path"), ",").alias("paths"), F.count("*").alias("n")).where("n > 1")
        files = markdown.files(self.spark, self.root).select("file_path").join(entries.select("file_path"), "file_path", "left_anti")
        nfc = lambda: checks.nfc_residuals(entries).select("rule_id", F.lit("high").alias("severity"), F.col("id").alias("target_id"), F.concat_ws(": ", "field", "value").alias("message"))
        aliases = lambda: checks.cross_language_aliases(entries).withColumn("pair", F.concat("left_id", F.lit(" vs "), "right_id"))
        fallback = lambda: checks.fallback_summary(logs.fallbacks(self.spark, self.root), int(time.time())).withColumn("said", F.concat_ws(": ", "n", F.array_join("tokens", ",")))
        stale = lambda: rules.metrics_stale(entries, self.metrics().select("entry_id", "updated_at"))
        return self._findings({
            "broken_relations": lambda: plain(rules.broken_relations(entries, edges), "broken_relations", "high", "source_id", "target_id"),
            "alias_conflicts": lambda: plain(rules.alias_conflicts(entries), "alias_conflicts", "medium", "alias", "ids"),
            "orphan_relation_type": lambda: plain(rules.orphan_relation_types(edges), "orphan_relation_type", "warning", "type", "type"),
            "id_uniqueness": lambda: plain(twice, "id_uniqueness", "high", "id", "paths"), "orphan_files": lambda: plain(files, "orphan_files", "medium", "file_path", "file_path"),
            "terminology_near_duplicate": lambda: plain(rules.term_near_duplicates(entries), "terminology_near_duplicate", "medium", "left_term", "right_term"),
            "terminology_cross_language_alias": lambda: plain(aliases(), "terminology_cross_language_alias", "medium", "pair", "shared"),
            "nfc_residual": nfc, "fullwidth_in_body": lambda: plain(checks.fullwidth(entries), "fullwidth_in_body", "low", "id", "char"),
            "tokenizer_fallback_summary": lambda: plain(fallback(), "tokenizer_fallback_summary", "medium", "said", "said"),
            "metrics_stale": lambda: plain(stale(), "metrics_stale", "medium", "id", "gap_hours"),
        })

    def _findings(self, found: dict[str, Callable[[], DataFrame]]) -> DataFrame:
        """All rules' findings, each worked out by itself; what a rule fails with is in `failures`, and the others count."""
        self.failures: dict[str, str] = {}
        union = self.spark.createDataFrame([], "rule_id string, severity string, target_id string, message string")
        for name, rule in found.items():
            try:
                union = union.unionByName(graph.cut(rule()))
            except Exception as e:  # any failure stays this rule's
                self.failures[name] = f"{type(e).__name__}: {e}"
        paths = self.entries().select(F.col("id").alias("target_id"), F.col("file_path").alias("target_path"))
        return union.join(paths, "target_id", "left").select("rule_id", "severity", "target_id", "target_path", "message")

    # --- dense index
    def dense_store(self) -> DataFrame:
        return self.tables.read("dense", dense.STORE_SCHEMA)

    def rebuild_dense(self, embedder: dense.Embedder = dense.hashed, only_stale: bool = True) -> DataFrame:
        """Embed stale (or all) active entries; gives what failed."""
        wanted = dense.stale(self.entries(), self.dense_store()) if only_stale else self.entries().where("status <> 'archived'").select("id")
        rows, failures = dense.embedded(self.entries().join(wanted, "id", "left_semi"), embedder)
        self.tables.merge("dense", dense.STORE_SCHEMA, rows, ["entry_id"])
        return failures

    def search_dense(self, query: str, limit: int = 20, embedder: dense.Embedder | None = dense.hashed) -> DataFrame:
        """(id, score) by vectors; empty where there is no embedder or no vector, or where the embedder fails."""
        none = self.spark.createDataFrame([], "id string, score double")
        if embedder is None or not dense.enabled(self.dense_store(), embedder):
            return none
        try:
            found = dense.dense_hits(self.dense_store(), query, limit, embedder)
        except Exception as e:  # search goes on without its vector route
            self.failures = {"dense": f"{type(e).__name__}: {e}"}
            return none
        return found.join(self.entries().where("status <> 'archived'").select("id"), "id", "left_semi")

    def recompute_neighbours(self, entry_id: str) -> int:
        """Metrics of an entry, its neighbours and all whose evidence leads to it, anew; the others' aren't worked out. Gives how many."""
        entries, edges, held = self.entries(), self.relations(), self.metrics()
        own = self.spark.createDataFrame([(entry_id,)], "id string")
        near = lists.affected(own, edges, edges).join(entries, "id", "left_semi")
        touched = cut(metrics.dependants(own, entries, edges, edges).unionByName(near.select("id")).distinct())
        fresh = metrics.entry_metrics(entries, edges, self.access_log(), self.today.isoformat(), touched).withColumnRenamed("id", "entry_id")
        rows = fresh.join(held.select("entry_id", "authority_score"), "entry_id", "left").withColumn("authority_score", F.coalesce("authority_score", F.lit(0.0)))
        rows = rows.withColumn("updated_at", F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")).select(*held.columns)
        rows = cut(rows)
        self.tables.replace("metrics", METRICS_SCHEMA, touched.select(F.col("id").alias("entry_id")), rows, ["entry_id"])
        return touched.count()

    # --- queue
    def enqueue(self, findings: DataFrame, origin: str = "diagnose", agent_id: str | None = None) -> None:
        """Queue findings that are not low. Those of one rule, entry, origin, proposed operation and payload are one item: its details
        hold how many messages there are and the first MESSAGES of them, with those of a pending item that is there already,
        which keeps its id, message and age."""
        now = F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")
        channel = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in CHANNELS.items()])
        own = lambda c: F.col(c) if c in findings.columns else F.lit(None).cast("string").alias(c)
        new = findings.where("severity <> 'low'").select("rule_id", "severity", F.col("target_id").alias("entry_id"), own("proposed_op"), own("proposed_payload_json"), F.lit(origin).alias("origin"), "message")
        part = [F.coalesce(c, F.lit("")).alias(f"k_{c}") for c in ("rule_id", "entry_id", "origin", "proposed_op", "proposed_payload_json")]
        key = ["k_rule_id", "k_entry_id", "k_origin", "k_proposed_op", "k_proposed_payload_json"]
        held = self.queue().where("status = 'pending'").select("*", *part)
        said = F.from_json("details_json", "messages array<string>, n long")["messages"]
        old = held.select(*key, F.explode(F.coalesce(said, F.array("message"))).alias("message")).select(*key, "message")
        messages = new.select(*part, "message").unionByName(old.join(new.select(*part).distinct(), key, "left_semi")).where("message is not null").distinct()
        place = F.row_number().over(Window.partitionBy(*key).orderBy("message"))
        listed = messages.withColumn("place", place).groupBy(*key).agg(
            F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= MESSAGES, F.col("message")))).alias("messages")
        )
        items = new.select("*", *part).groupBy(*key).agg(*[F.min(c).alias(c) for c in new.columns])
        first = held.groupBy(*key).agg(F.min("id").alias("held"), F.min("created_at").alias("first"), F.min_by("message", "id").alias("was"))
        fresh = F.concat(F.lit("mq_"), F.substring(F.sha2(F.concat_ws("|", *key, F.lit(ulid())), 256), 1, 26))
        rows = items.join(first, key, "left").join(listed, key, "left").select(
            F.coalesce("held", fresh).alias("id"), "rule_id", "severity", "entry_id", channel.alias("channel"), F.lit("pending").alias("status"), F.coalesce("was", "message").alias("message"),
            F.to_json(F.struct("messages", "n")).alias("details_json"), "origin", "proposed_op", "proposed_payload_json", F.lit(agent_id).cast("string").alias("agent_id"),
            F.coalesce("first", now).alias("created_at"), now.alias("updated_at"),
        )
        self.tables.merge("queue", QUEUE_SCHEMA, rows, ["id"])

    def transition(self, queue_id: str, status: str) -> None:
        """pending to sent, and either to resolved or dismissed; anything else raises."""
        row = self.queue().where(F.col("id") == queue_id).first()
        if row is None:
            raise NotFoundError(queue_id)
        if status not in {"pending": ("sent", "resolved", "dismissed"), "sent": ("resolved", "dismissed")}.get(row.status, ()):
            raise ConflictError(f"{row.status} to {status}")
        changed = self.queue().where(F.col("id") == queue_id).withColumn("status", F.lit(status)).withColumn("updated_at", F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp"))
        self.tables.merge("queue", QUEUE_SCHEMA, changed, ["id"])


SCHEMAS = {"entries": ENTRY_SCHEMA, "relations": RELATION_SCHEMA, "findings": FINDING_SCHEMA, "queue": QUEUE_SCHEMA, "access_log": ACCESS_SCHEMA, "metrics": METRICS_SCHEMA}
