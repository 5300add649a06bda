"""Article connectors: API responses, retry rules, and scans of article tables into corpora."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import sampling as P
from lexiloom.operators import units as U

WAIT_STATUS = (429, 503)
_PAGES = "map<string, struct<title: string, extract: string, missing: string>>"


def extract(response: Column) -> Column:
    """struct<page_id, title, body> of the first page of an API response; null if it is missing or there is none."""
    pages = F.map_entries(F.from_json(F.get_json_object(response, "$.query.pages"), _PAGES))
    first = F.get(pages, 0)
    found = first.isNotNull() & (first["key"] != "-1") & first["value"]["missing"].isNull()
    return F.when(found, F.struct(first["key"].alias("page_id"), first["value"]["title"].alias("title"), F.coalesce(first["value"]["extract"], F.lit("")).alias("body")))


def fetch(get: Callable[[str], tuple[int, dict, str]], title: str, retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> str:
    """The response text of a title: waits as told (or 1, 2, 4, ... seconds) while the server is busy.

    get: a client that gives status, headers and text; RuntimeError after the last attempt or on another status.
    """
    for attempt in range(retries):
        status, headers, text = get(title)
        if status not in WAIT_STATUS:
            if status >= 400:
                raise RuntimeError(f"status {status} for {title!r}")
            return text
        sleep(float(headers.get("Retry-After", 2**attempt)))
    raise RuntimeError(f"still busy after {retries} attempts for {title!r}")


def load(responses: DataFrame, language: str = "en", skip_missing: bool = True) -> DataFrame:
    """(n, asked, response) -> documents by resolved title, the last of a title by n; a missing one goes or is an error."""
    page = extract(F.col("response"))
    if not skip_missing:
        page = F.when(page.isNull(), F.raise_error(F.concat(F.lit("article not found: "), F.col("asked"))).cast("struct<page_id:string,title:string,body:string>")).otherwise(page)
    rows = responses.select("n", page.alias("p")).where("p is not null")
    last = rows.groupBy(F.col("p.title").alias("doc_id")).agg(F.max_by("p", "n").alias("p"))
    meta = F.create_map(*[x for k, v in {"source": F.lit("wikipedia"), "via": F.lit("api"), "language": F.lit(language), "title": F.col("p.title"), "page_id": F.col("p.page_id")}.items() for x in (F.lit(k), v)])
    return last.select("doc_id", F.col("p.body").alias("body"), meta.alias("meta"))


def scan(articles: DataFrame, terms: list[str], k: int = 100, seed: int = 123, most_rows: int | None = 500_000, least_hits: int = 2, least_chars: int = 1000, most_chars: int = 15000) -> DataFrame:
    """(title, text) -> (title, body, hits): a reservoir of k articles with the terms.

    In this order: the scan limit, pages that are no articles, the appendix, the least length, hits over the whole body,
    the cut to most_chars, the sample. Of a repeated title one stays.
    """
    rows = articles if most_rows is None else articles.limit(most_rows)
    rows = rows.where(~U.is_junk(F.col("title"), F.col("text"))).select("title", U.clean_body(F.col("text")).alias("body")).where(F.length("body") >= least_chars)
    rows = rows.withColumn("hits", U.hits(F.col("body"), terms)).where(F.col("hits") >= least_hits).withColumn("body", F.substring("body", 1, most_chars))
    return P.random(rows.dropDuplicates(["title"]), k, ["title"], seed)


def ensure_minimum(have: DataFrame, more: DataFrame, word: str, least: int, mode: str = "exact") -> DataFrame:
    """have, and where fewer than `least` of its documents hold the word also max(3 * least, 20) others that do, none overwritten.

    Both are (doc_id, body, ...). Whether more are needed is decided in the plan, not by a job of its own.
    """
    enough = U.with_word(have, word, mode).limit(least).agg((F.count(F.lit(1)) >= least).alias("enough"))
    hits = F.regexp_count("body", F.lit(T.pattern(word, mode)))
    found = U.with_word(more, word, mode).join(have.select("doc_id"), "doc_id", "left_anti").withColumn("__hits", hits)
    found = found.orderBy(F.desc("__hits"), "doc_id").limit(max(3 * least, 20)).drop("__hits")
    return have.unionByName(found.crossJoin(F.broadcast(enough)).where("not enough").drop("enough"))
