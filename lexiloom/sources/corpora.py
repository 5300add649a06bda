"""Corpus sources and sinks: files, single files with separators, JSON wrappers, tables, and an article connector."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, body string, meta map<string,string>"


def from_rows(spark: SparkSession, rows: list[tuple[str, str, dict]]) -> DataFrame:
    """Documents given one by one; a body must be a string."""
    for _, body, _ in rows:
        if not isinstance(body, str):
            raise TypeError("a body must be a string")
    return spark.createDataFrame(rows, SCHEMA)


def from_table(df: DataFrame, doc_id: str, body: str, *meta: str) -> DataFrame:
    pairs = [x for m in meta for x in (F.lit(m), F.col(m).cast("string"))]
    return df.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(body).alias("body"), (F.create_map(*pairs) if pairs else F.expr("map()").cast("map<string,string>")).alias("meta"))


def files(spark: SparkSession, folder: str, extension: str = ".txt", recursive: bool = False) -> DataFrame:
    """(path, body): one row a file, the path relative to the folder."""
    reader = spark.read.option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", recursive)
    rows = reader.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("body"))
    root = re.sub(r"^\w+:/*", "/", folder).rstrip("/") + "/"
    return rows.select(F.regexp_replace(F.url_decode(F.regexp_replace("full", r"\+", "%2B")), r"^\w+:/*", "/").alias("full"), "body").select(F.expr(f"substring(full, {len(root) + 1})").alias("path"), "body")


def path_metadata(path: Column, folders: list[str | None], file_key: str | None = None) -> Column:
    """map of folder names by key (the shorter side wins; a blank or missing key is skipped) and of the file's stem."""
    parts = F.split(path, "/")
    held = [F.when(F.size(parts) > i + 1, F.struct(F.lit(k).alias("k"), F.get(parts, i).alias("v"))) for i, k in enumerate(folders) if k and k.strip()]
    if file_key:
        held.append(F.struct(F.lit(file_key).alias("k"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("v")))
    return F.map_from_entries(F.filter(F.array(*held), lambda x: x.isNotNull())) if held else F.expr("map()").cast("map<string,string>")


def from_files(spark: SparkSession, folder: str, extension: str = ".txt", recursive: bool = False, folders: list[str | None] | None = None, file_key: str | None = None,
               defaults: dict[str, str] | None = None, source_key: str | None = None, per_document: DataFrame | None = None) -> DataFrame:
    """One document a file; the id is the relative path without extension, / as __. Later metadata wins:
    defaults, path, source, and per_document (doc_id, meta)."""
    rows = files(spark, folder, extension, recursive)
    base = {"source": "files", **(defaults or {})}
    meta = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    rows = rows.select(F.replace(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("/"), F.lit("__")).alias("doc_id"), "body", meta.alias("m1"), path_metadata(F.col("path"), folders or [], file_key).alias("m2"))
    rows = rows.withColumn("meta", merge(F.col("m1"), F.col("m2")))
    if source_key:
        rows = rows.withColumn("meta", merge(F.col("meta"), F.create_map(F.lit("source"), F.coalesce(F.try_element_at("meta", F.lit(source_key)), F.try_element_at("meta", F.lit("source"))))))
    if per_document is not None:
        rows = rows.join(per_document.select("doc_id", F.col("meta").alias("m3")), "doc_id", "left").withColumn("meta", F.when(F.col("m3").isNull(), F.col("meta")).otherwise(merge(F.col("meta"), F.col("m3"))))
    return rows.select("doc_id", "body", "meta")


def merge(a: Column, b: Column) -> Column:
    """Map union in which b wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def from_single_file(spark: SparkSession, path: str, separator: str = "", header: bool = False, body_separator: str = "\n\n", field_separator: str = "|", key_value: str = "=") -> DataFrame:
    """One file cut at a literal separator (empty: whole); blank documents go but keep their number in document_index.

    With a header, fields before body_separator are key=value, or meta_1, meta_2, ... by position. The id is the first of
    doc_id, id, title, else the file's name and number; a repeated id gets _2, _3, ...
    """
    from pyspark.sql import Window as W

    raw = spark.read.text(path, wholetext=True)
    parts = F.split("value", re.escape(separator).replace("\\\n", "\n"), -1) if separator else F.array("value")
    rows = raw.select(F.posexplode(parts).alias("i", "t")).select((F.col("i") + 1).alias("document_index"), F.trim(F.regexp_replace("t", r"^\s+|\s+$", "")).alias("t")).where("t <> ''")
    none = F.expr("map()").cast("map<string,string>")
    if header:
        cut = F.split("t", re.escape(body_separator).replace("\\\n", "\n"), 2)
        fields = F.split(F.get(cut, 0), re.escape(field_separator))
        pair = lambda f, i: F.when(F.contains(f, F.lit(key_value)), F.struct(F.trim(F.get(F.split(f, re.escape(key_value), 2), 0)).alias("k"), F.trim(F.get(F.split(f, re.escape(key_value), 2), 1)).alias("v"))).otherwise(F.struct(F.concat(F.lit("meta_"), (i + 1).cast("string")).alias("k"), F.trim(f).alias("v")))
        rows = rows.select("document_index", F.trim(F.get(cut, 1)).alias("body"), F.map_from_entries(F.transform(fields, pair)).alias("meta"))
    else:
        rows = rows.select("document_index", F.col("t").alias("body"), none.alias("meta"))
    stem = re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])
    name = F.coalesce(*[F.try_element_at("meta", F.lit(k)) for k in ("doc_id", "id", "title")], F.format_string(f"{stem}_%04d", "document_index"))
    name = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w.-]+", "_"), "^_+|_+$", "")
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("document_index"))
    rows = rows.withColumn("doc_id", name).withColumn("n", n)
    doc_id = F.when(F.col("n") > 1, F.concat("doc_id", F.lit("_"), F.col("n").cast("string"))).otherwise(F.col("doc_id"))
    return rows.select(doc_id.alias("doc_id"), "body", merge(F.col("meta"), F.create_map(F.lit("document_index"), F.col("document_index").cast("string"))).alias("meta"))


def file_tree(spark: SparkSession, folder: str, extension: str = ".txt") -> DataFrame:
    """n_files, least and greatest depth, first five paths."""
    rows = files(spark, folder, extension, True).select("path", (F.size(F.split("path", "/")) - 1).alias("depth"))
    counts = rows.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.min("depth"), F.lit(0)).alias("min_depth"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    first = rows.select("path").distinct().orderBy("path").limit(5).agg(F.array_sort(F.collect_list("path")).alias("examples"))
    return counts.crossJoin(first)


def save(df: DataFrame, path: str, stage: str = "") -> None:
    """Parquet data beside a one-row summary."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    counts = df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_articles"))
    counts.write.mode("overwrite").parquet(f"{path}/summary")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON corpus, bare or within {summary, data}."""
    kind = "map<string, struct<body: string, meta: map<string, string>>>"
    raw = spark.read.text(path, wholetext=True)
    data = F.coalesce(F.get_json_object("value", "$.data"), F.col("value"))
    rows = raw.select(F.explode(F.from_json(data, kind)).alias("doc_id", "d"))
    return rows.select("doc_id", "d.body", "d.meta")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one text file, numbered from 1."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "value"))
    return rows.select((F.col("i") + 1).alias("line"), "value")


def pairs_of(rows: DataFrame) -> DataFrame:
    """(line, value) -> (line, word_a, word_b) of values a-b; others go."""
    rows = rows.select("line", F.split(F.trim("value"), "-").alias("p")).where(F.size("p") == 2)
    return rows.select("line", F.trim(F.get("p", 0)).alias("word_a"), F.trim(F.get("p", 1)).alias("word_b"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(line, word_a, word_b) of the lines a-b of a file; others go."""
    return pairs_of(lines(spark, path))


def concepts_of(rows: DataFrame) -> DataFrame:
    """(line, value) -> (line, concept) without the quotes around it."""
    return rows.select("line", F.regexp_replace(F.trim("value"), '^"+|"+$', "").alias("concept")).where("concept <> ''")


def concepts(spark: SparkSession, path: str) -> DataFrame:
    return concepts_of(lines(spark, path))


def by_line(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that stand on the same line."""
    return a.join(b, "line")


def year_newspaper(path: Column) -> Column:
    """map of year, newspaper and article_id: the first folder of four digits that two parts follow, the next part, the stem; else empty."""
    parts = F.split(path, "/")
    head = F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0)))
    at = F.array_position(F.transform(head, lambda x: x.rlike("^[0-9]{4}$")), True)
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    found = F.create_map(F.lit("year"), F.get(parts, (at - 1).cast("int")), F.lit("newspaper"), F.get(parts, at.cast("int")), F.lit("article_id"), stem)
    return F.when(at > 0, found).otherwise(F.expr("map()").cast("map<string,string>"))


def folder_values(paths: DataFrame, most: int = 8) -> DataFrame:
    """(path) -> (level, value, rank): the first names of folders of each level, sorted."""
    from pyspark.sql import Window as W

    parts = F.split("path", "/")
    names = paths.select(F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("level", "value")).distinct()
    return names.withColumn("rank", F.row_number().over(W.partitionBy("level").orderBy("value"))).where(F.col("rank") <= most)


def first_by_priority(paths: DataFrame, names: list[str]) -> DataFrame:
    """(path) of run/name -> (run, path): of each run the file whose name comes first in the list."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.element_at(F.split("path", "/"), -1))
    rows = paths.where(F.size(F.split("path", "/")) >= 2).select("path", F.element_at(F.split("path", "/"), -2).alias("run"), rank.alias("rank")).where("rank > 0")
    return rows.groupBy("run").agg(F.min_by("path", "rank").alias("path"))


def to_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; mode overwrite or append."""
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be overwrite or append")
    df.write.mode(mode).option("header", True).csv(path)


def save_lsa(path: str, terms: DataFrame, documents: DataFrame, values: list[float], convention: dict[str, str] | None = None) -> dict[str, str]:
    """Vectors of terms and documents, singular values and a metadata row below a folder; what stands where."""
    spark = terms.sparkSession
    out = {k: f"{path.rstrip('/')}/{k}" for k in ("word_vectors", "document_vectors", "singular_values", "metadata")}
    terms.write.mode("overwrite").parquet(out["word_vectors"])
    documents.write.mode("overwrite").parquet(out["document_vectors"])
    spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "k int, value double").write.mode("overwrite").parquet(out["singular_values"])
    meta = {"method": "lsa", "n_components": str(len(values)), **(convention or {})}
    spark.createDataFrame([(meta,)], "metadata map<string,string>").write.mode("overwrite").json(out["metadata"])
    return out


def vector_response(x: Column) -> Column:
    """array<double> of a response with <dim> elements and decimal commas."""
    return F.transform(F.regexp_extract_all(x, F.lit("<dim>(.*?)</dim>"), F.lit(1)), lambda d: F.replace(d, F.lit(","), F.lit(".")).cast("double"))


class Articles(Protocol):
    """A store of articles by title; a network client can stand in for the table-backed one."""

    def fetch(self, titles: DataFrame) -> DataFrame: ...

    def search(self, term: str, n: int) -> DataFrame: ...


class TableArticles:
    """Articles of a table (title, body)."""

    def __init__(self, table: DataFrame):
        self.table = table

    def fetch(self, titles: DataFrame) -> DataFrame:
        """Articles of (title), missing ones left out; a title asked for twice gives one."""
        return self.table.join(titles.select("title").distinct(), "title", "left_semi").select(F.col("title").alias("doc_id"), "body", F.create_map(F.lit("title"), F.col("title")).alias("meta"))

    def search(self, term: str, n: int = 20) -> DataFrame:
        from lexiloom.functions.text import pattern

        hits = F.regexp_count("body", F.lit(pattern(term)))
        return self.table.select("title", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "title").limit(n)

    def search_and_load(self, term: str, n: int, exclude: DataFrame) -> DataFrame:
        return self.fetch(self.search(term, n).join(exclude.select("title"), "title", "left_anti"))
