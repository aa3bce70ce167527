"""The engine's entry points over captured answers and a snapshot store.

``captures`` holds a row per captured answer: source, url, code, header, body. Results of a source
come from its JSON envelope, or, for other sources, from rows prepared by the caller (``results``).
"""

from __future__ import annotations

import json
import uuid
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.operators import canonical, dedup, federate, quality, store
from recordlake.plans.search_query import ORDER_KEYS, SearchQuery
from recordlake.shipping import ship
from recordlake.sources import readers, registry
from recordlake.sources.envelopes import ENVELOPES, parse_results

RECORD_SCHEMA = "kind string, id string, source string, court string, case_number string, subject string, rapporteur string, decision_type string, precedent_type string, summary string, publication_date string, updated_at string, created_at string, canonical_key string"


#: Filters that apply where the results have a column of that name.
LOCAL_FILTERS = ("party_name", "party_document", "lawyer_name", "oab", "precatory_number", "police_document", "cda")


class UnknownSourceError(KeyError):
    """A source that is neither registered nor prepared."""


class Engine:
    """Search, collect, store and export over one session."""

    def __init__(self, spark: SparkSession, captures: DataFrame | None = None, results: DataFrame | None = None, root: str | None = None):
        ship(spark)
        self.spark, self.captures, self.prepared, self.root = spark, captures, results, root
        self._known: set[str] | None = None

    # sources

    def list_sources(self) -> DataFrame:
        return registry.capabilities(self.spark).orderBy("source")

    def get_capabilities(self, source: str) -> DataFrame:
        return registry.capabilities(self.spark).filter(F.col("source") == source)

    def source_results(self, source: str) -> DataFrame:
        """All results of one source."""
        if source in ENVELOPES and self.captures is not None:
            return parse_results(self.captures.filter(F.col("source") == source), source)
        if self.prepared is not None:
            return self.prepared.filter(F.col("source") == source)
        raise UnknownSourceError(source)

    # search

    def search(self, source: str, query: SearchQuery) -> DataFrame:
        """One page of one source that fits the query."""
        found = self._fitting(self.source_results(source), query)
        by = ORDER_KEYS[query.order_by]
        by = by if by in found.columns else "publication_date"  # one source's results have no score
        return found.orderBy(F.desc_nulls_last(by), "id").offset((query.page - 1) * query.page_size).limit(query.page_size)

    def _fitting(self, results: DataFrame, query: SearchQuery) -> DataFrame:
        hay = F.concat_ws(" ", *(c for c in ("number", "question", "thesis", "summary", "full_text") if c in results.columns))
        tests = [query.word_predicate(hay, folded=True), query.date_predicate(F.col("publication_date"), F.col("updated_at"))]
        tests += [F.col("rapporteur").contains(query.rapporteur)] * bool(query.rapporteur) + [F.col("number") == query.number] * bool(query.number)
        tests += [F.col("court").isin(list(query.courts))] * bool(query.courts) + [F.col("type").isin(list(query.types))] * bool(query.types)
        if "cancelled" in results.columns and not query.include_cancelled:
            tests.append(~F.coalesce(F.col("cancelled"), F.lit(False)))
        asked = [n for n in LOCAL_FILTERS if n in query.active_filters()]
        tests += [F.col(n) == getattr(query, n) for n in asked if n in results.columns]
        if left := [n for n in asked if n not in results.columns]:
            warnings.warn(f"not applied, the results don't have them: {', '.join(left)}", stacklevel=3)
        return results.filter(reduce(lambda a, b: a & b, tests))

    def search_canonical(self, source: str, query: SearchQuery) -> tuple[DataFrame, DataFrame]:
        """Decisions and precedents of a page."""
        page = store.migrate(self.search(source, query), {"access_status": "string", "extraction_status": "string"})
        return canonical.to_decisions(page), canonical.to_precedents(page)

    def search_many(self, query: SearchQuery, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """The global ranked page over sources, and its envelope; sources by name, or those that the query is routed to.

        Routed sources without any results at hand can't be searched: ``search_report`` names them.
        """
        routed = [r["source"] for r in self.route(query).filter("searched").orderBy("source").collect()] if sources is None else sources
        names = [s for s in routed if sources is not None or self._has_results(s)]
        if not names:
            raise UnknownSourceError("no source")
        parts = federate.concatenate({s: self._fitting(self.source_results(s), query) for s in names})
        arrival = [F.asc("source_order"), F.asc("url" if "url" in parts.columns else "id"), F.asc("position" if "position" in parts.columns else "id")]
        parts = federate.fetch_window(parts, query.page, query.page_size, arrival)
        unique = federate.rank_dedup(parts, query.text, arrival)
        return federate.ranked_page(unique, query.page, query.page_size), federate.envelope(parts, unique, query.page, query.page_size)

    def _available(self) -> set[str]:
        """Sources that have captured answers in a known form, or prepared results."""
        if self._known is None:
            found = set()
            if self.captures is not None:
                found |= {r[0] for r in self.captures.select("source").distinct().collect()} & set(ENVELOPES)
            if self.prepared is not None:
                found |= {r[0] for r in self.prepared.select("source").distinct().collect()}
            self._known = found
        return self._known

    def _has_results(self, source: str) -> bool:
        return source in self._available()

    def search_report(self, query: SearchQuery) -> DataFrame:
        """What a federated search does with every source: searched, or skipped and why."""
        have = F.col("source").isin(sorted(self._available()))
        routed = self.route(query)
        reason = F.when(F.col("searched") & ~have, "no_results_at_hand").otherwise(F.col("skip_reason"))
        return routed.select("source", reason.alias("skip_reason"), reason.isNull().alias("searched"), "warnings")

    def route(self, query: SearchQuery) -> DataFrame:
        """Every source with its skip reason or warnings, by the category and filters that it declares."""
        return federate.route_sources(registry.capabilities(self.spark), query.identifiers(), query.refinements(), registry.DEFAULT_CATEGORIES)

    # store

    def _table(self, name: str, schema: str) -> DataFrame:
        return store.latest(self.spark, self.root).table(name, schema)

    def records(self) -> DataFrame:
        return self._table("records", RECORD_SCHEMA)

    def conflicts(self) -> DataFrame:
        """Records that were not stored: each matched one stored record by its id and another by its key."""
        return self._table("conflicts", RECORD_SCHEMA + ", run_id string")

    def search_and_store_run(self, source: str, query: SearchQuery, now: str, label: str | None = None) -> str:
        """Stores a page of results and a run that links to them as one commit; returns the run's id."""
        run = f"run-{uuid.uuid4().hex}"
        decisions, precedents = self.search_canonical(source, query)
        kinds = dict(f.split() for f in RECORD_SCHEMA.split(", "))
        rows = decisions.unionByName(precedents, allowMissingColumns=True).withColumns({"created_at": F.lit(now), "updated_at": F.lit(now)})
        rows = store.migrate(rows, kinds).select(*kinds).withColumn("position", F.monotonically_increasing_id())
        values = {"id": run, "source": source, "text": query.text, "query": json.dumps(query.active_values(), ensure_ascii=False, sort_keys=True), "label": label, "created_at": now}
        about = rows.agg(F.count(F.lit(1)).alias("record_count")).select(*(F.lit(v).cast("string").alias(n) for n, v in values.items()), "record_count")
        store.commit(self.spark, self.root, store.run_save(run, rows, about, RECORD_SCHEMA))
        return run

    def get_research_run_records(self, run: str, limit: int = 20, offset: int = 0) -> DataFrame:
        return store.run_records(self._table("links", store.LINK_SCHEMA), self.records(), F.lit(run), limit, offset)

    def list_research_runs(self) -> DataFrame:
        return store.list_runs(self._table("runs", store.RUN_SCHEMA))

    def get_document(self, kind: str, id_: str) -> DataFrame:
        """One record by its kind and id, from the files that can hold it."""
        now = store.latest(self.spark, self.root)
        return store.lookup(now, "records", kind=kind, id=id_)[0] if "records" in now.tables else self.records().limit(0)

    # datasets and quality

    def list_source_datasets(self, catalogue: DataFrame) -> DataFrame:
        return readers.describe_datasets(catalogue)

    def plan_source_sync(self, resources: DataFrame, manifest: DataFrame, formats: list[str], cap: int = 50 << 20, limit: int = 100) -> DataFrame:
        """Resources to fetch: wanted formats within the cap that are not synced with the same fingerprint."""
        return dedup.unsynced(readers.plan_downloads(resources, formats, cap, limit), manifest, ["source", "dataset_id", "resource_id"])

    def sync_source_resource(self, rows: DataFrame, dataset: str, position: str = "position") -> tuple[DataFrame, DataFrame]:
        """Decisions of a dataset's rows (last of each id) and the counters of the sync."""
        valid = rows.filter(F.nullif(F.trim("id"), F.lit("")).isNotNull())
        return canonical.dataset_decisions(dedup.last_wins(valid, ["id"], position), F.lit(dataset)), dedup.sync_counters(rows, "id")

    def validate_sources(self, pages: DataFrame, results: DataFrame, page_size: int = 10) -> DataFrame:
        return quality.validation_report(pages, results, page_size)
