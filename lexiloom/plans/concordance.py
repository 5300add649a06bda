"""Sampled concordances from one configuration, with a decision log."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexiloom.operators import sampling as P
from lexiloom.operators import units as U
from lexiloom.plans.trace import TraceLog


@dataclass
class Config:
    word: str
    mode: str = "exact"
    source: str | None = None
    document_strategy: str | None = "reservoir"
    n_documents: int | None = 200
    occurrence_strategy: str = "reservoir"
    n_occurrences: int | None = 100
    per_document: int | None = 3
    min_distance: int = 0
    window: str = "words"
    size: int = 10
    seed: int = 0


def run(documents: DataFrame, c: Config, log: TraceLog | None = None) -> DataFrame:
    """doc_id, occ, start, end, left, text, right, w_start, w_end, source; one lazy plan. No document strategy: one stage."""
    log = log if log is not None else TraceLog()
    docs = documents.where(documents["source"].startswith(c.source)) if c.source else documents
    if c.document_strategy:
        found = P.apply(U.with_word(docs, c.word, c.mode).select("doc_id", "source"), c.document_strategy, c.n_documents, ["doc_id"], "source", c.seed)
        docs = docs.join(found.select("doc_id"), "doc_id", "left_semi")
        log.record("documents", asdict(c))
    occ = U.segments(docs, c.word, c.mode).drop("body")
    key = ["doc_id", "start"]
    if c.per_document and c.min_distance:
        occ = P.cap_per_group_spaced(occ, c.per_document, "doc_id", ["start"], "start", c.min_distance, c.seed)
    elif c.per_document:
        occ = P.cap_per_group(occ, c.per_document, "doc_id", key, c.seed)
    occ = P.apply(occ, c.occurrence_strategy, c.n_occurrences, key, "source", c.seed)
    log.record("occurrences", asdict(c))
    return U.kwic(occ, c.window, c.size, documents)


def cap_feasibility(n_articles: int, cap: int | None, target: int | None) -> dict[str, int | bool | None]:
    """Whether a cap per article lets the target be reached, the ceiling, and what would be needed (None: no ceiling, or no articles)."""
    if not cap or not target:
        return {"feasible": True, "ceiling": None, "needed_articles": None, "needed_cap": None}
    ceiling = n_articles * cap
    return {"feasible": ceiling >= target, "ceiling": ceiling, "needed_articles": -(-target // cap), "needed_cap": -(-target // n_articles) if n_articles else None}


def needs_count(strategy: str) -> bool:
    return strategy in ("random", "stratified", "reservoir")


def strategies(n_sources: int) -> list[str]:
    """What can be chosen: strata only where there is more than one source."""
    return ["exhaustive", "random", "reservoir", *(["stratified"] if n_sources > 1 else [])]


def check(c: Config) -> None:
    """Errors of a configuration before anything runs."""
    for strategy, n in ((c.document_strategy, c.n_documents), (c.occurrence_strategy, c.n_occurrences)):
        if strategy and strategy not in strategies(2):
            raise ValueError(f"unknown strategy {strategy!r}")
        if strategy and needs_count(strategy) and not n:
            raise ValueError(f"{strategy} needs a number")


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df with a counter that the query itself fills: its rows and documents, without a job of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct("doc_id").alias("n_documents")), seen


def sentence_or_document(documents: DataFrame, unit: str, c: Config) -> DataFrame:
    """Sentences or whole documents as units; they are sampled only where a number is set."""
    if unit not in ("sentence", "document"):
        raise ValueError("unit must be sentence or document")
    docs = documents.where(documents["source"].startswith(c.source)) if c.source else documents
    units = U.sentences(docs) if unit == "sentence" else U.whole(docs)
    return P.apply(units, c.occurrence_strategy, c.n_occurrences, ["doc_id", "start"], "source", c.seed) if c.n_occurrences else units
