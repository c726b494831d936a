"""Keyed tables: upserts, deletion, look-ups, pages, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole rows replaced by key, and new ones added."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_merge(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Column by column: a new value that isn't null wins."""
    o, n = stored.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    names = [*stored.columns, *(c for c in new.columns if c not in stored.columns)]
    pick = lambda c: F.coalesce(*(F.col(f"{t}.{c}") for t, cols in (("n", new.columns), ("o", stored.columns)) if c in cols)).alias(c)
    return o.join(n, on, "full_outer").select(*map(pick, names))


def delete(stored: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    return stored.join(keys.select(*by), by, "left_anti")


def delete_relation_vectors(vectors: DataFrame, names: DataFrame) -> DataFrame:
    """Without the rows whose source or target is named."""
    gone = names.select("name")
    return vectors.join(gone, F.col("src_id") == F.col("name"), "left_anti").join(gone, F.col("tgt_id") == F.col("name"), "left_anti")


def existing(stored: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Those of the keys that are stored."""
    return keys.join(stored.select(*by), by, "left_semi")


def get_many(stored: DataFrame, ids: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """Rows in the order of `pos`, nulls where an id isn't stored."""
    return ids.join(stored, key, "left").orderBy(pos)


def search_labels(entities: DataFrame, text: str) -> DataFrame:
    """Names with the text in them, whatever the case, sorted."""
    return entities.select("name").where(F.contains(F.lower("name"), F.lit(text.lower()))).distinct().orderBy("name")


def all_labels(entities: DataFrame) -> DataFrame:
    return entities.select("name").distinct().orderBy("name")


def page(rows: DataFrame, order: list[str | Column], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the page, a row with the total)."""
    return rows.orderBy(*order).offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"))


def by_status(status: DataFrame, value: str) -> DataFrame:
    return status.where(F.col("status") == value)


def by_path(status: DataFrame, path: str) -> DataFrame:
    """The first document of a path."""
    return status.where(F.col("file_path") == path).orderBy("doc_id").limit(1)


def with_findings(status: DataFrame) -> DataFrame:
    """Documents with personal data."""
    return status.where(F.size("pii_findings") > 0)


def groups(documents: DataFrame) -> DataFrame:
    """Distinct groups of the documents' policies, sorted."""
    return documents.select(F.explode("acl.visible_to_groups").alias("group_id")).distinct().orderBy("group_id")


def usage(events: DataFrame, by: list[str], tokens: str = "tokens") -> DataFrame:
    return events.groupBy(*by).agg(F.sum(tokens).alias("tokens"))


def over_budget(used: DataFrame, most: int, needed: int = 0) -> DataFrame:
    """Rows whose use and need exceed the budget; 0 is no limit."""
    return used.where(F.lit(most > 0) & (F.col("tokens") + needed > most))


def aged_out(cache: DataFrame, cutoff: Column, ts: str = "ts") -> DataFrame:
    """The cache without rows from before the cutoff."""
    return cache.where(F.col(ts) >= cutoff)


def invalidated(cache: DataFrame, dirty: DataFrame) -> DataFrame:
    """The cache (key, entities, ...) without the rows that any dirty entity (name) is part of."""
    hit = cache.select("key", F.explode("entities").alias("name")).join(dirty.select("name").distinct(), "name", "left_semi").select("key").distinct()
    return cache.join(hit, "key", "left_anti")


def recently_used(cache: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """The n rows that were used last; equal times go by key."""
    return cache.orderBy(F.desc(ts), "key").limit(n)


SCOPES = ("query", "extract", "summary", "vectors", "lexical")


def cleared(caches: dict[str, DataFrame], scope: str = "all") -> dict[str, DataFrame]:
    """The caches by name, empty where the scope asks for it: `llm` is query, extract and summary; `all` is every one."""
    if scope not in (*SCOPES, "llm", "all"):
        raise ValueError(f"unknown scope {scope}")
    gone = set(caches) if scope == "all" else {"query", "extract", "summary"} if scope == "llm" else {scope}
    return {name: clear(table) if name in gone else table for name, table in caches.items()}


def first_seen(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def export_graph(entities: DataFrame, relations: DataFrame, path: str, fmt: str = "json") -> None:
    """Nodes and edges, an edge once a direction, under path_nodes and path_edges; arrays are `|`-joined in CSV. An unknown format is JSON."""
    fmt = fmt if fmt in ("json", "csv", "parquet") else "json"
    for name, rows in (("nodes", entities), ("edges", relations.dropDuplicates(["src_id", "tgt_id"]))):
        if fmt == "csv":
            rows = rows.select(*(F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in rows.dtypes))
        writer = rows.write.mode("overwrite").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(f"{path}_{name}")


def save_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def migrate(spark, source: str, target: str, from_format: str = "json", to_format: str = "parquet", schema: str | None = None) -> None:
    """A cache in another format."""
    reader = spark.read.format(from_format)
    (reader.schema(schema) if schema else reader).load(source).write.mode("overwrite").format(to_format).save(target)


def clear(table: DataFrame) -> DataFrame:
    return table.limit(0)
