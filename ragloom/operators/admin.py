"""Settings, suggestions, prompts and diagnostics as functions on small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim

VISIBLE = ("general", "retrieval", "display", "models")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows replace those of equal key, and are added where there is none."""
    return table.join(rows.select(key), key, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def update_only(table: DataFrame, rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Existing keys take the new values; unknown keys are ignored."""
    new = rows.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    t = table.join(new, key, "left")
    return t.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(table.columns)


def seed_missing(table: DataFrame, seeds: DataFrame, key: str, only_if_empty: bool = False) -> DataFrame:
    """Seeds whose key is not there yet; with only_if_empty none if the table has any row."""
    if only_if_empty and not table.isEmpty():
        return table
    return table.unionByName(seeds.join(table.select(key), key, "left_anti").select(table.columns))


def setting(table: DataFrame, keys: DataFrame, default: str) -> DataFrame:
    """key, value: point look-ups with a default."""
    return keys.join(table.select("config_key", "config_value"), "config_key", "left").select("config_key", F.coalesce("config_value", F.lit(default)).alias("config_value"))


def flag(value: Column) -> Column:
    """On unless it is literally false; off where it is missing."""
    return F.coalesce(F.lower(trim(value)) != "false", F.lit(False))


def neighbours(suggestions: DataFrame) -> DataFrame:
    """id, previous, next by sort order."""
    w = Window.partitionBy(F.lit(1)).orderBy("sort_order", "id")  # a settings table of a few rows
    return suggestions.select("id", F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next"))


def swap_order(suggestions: DataFrame, a: int, b: int) -> DataFrame:
    two = suggestions.where(F.col("id").isin(a, b)).agg(F.max(F.when(F.col("id") == a, F.col("sort_order"))).alias("_a"), F.max(F.when(F.col("id") == b, F.col("sort_order"))).alias("_b"))
    t = suggestions.crossJoin(F.broadcast(two))  # one row
    order = F.when((F.col("id") == a) & F.col("_b").isNotNull(), F.col("_b")).when((F.col("id") == b) & F.col("_a").isNotNull(), F.col("_a")).otherwise(F.col("sort_order"))
    return t.select(*[order.alias(c) if c == "sort_order" else F.col(c) for c in suggestions.columns])


def resolve_prompts(registry: DataFrame, rows: DataFrame, superseded: DataFrame) -> DataFrame:
    """prompt_key, content, origin: the stored text unless blank or superseded, else the registry's default."""
    bad = superseded.select("prompt_key", F.col("content").alias("_c"), F.lit(True).alias("_bad")).distinct()
    stored = rows.select("prompt_key", F.nullif(F.col("content"), F.when(trim(F.col("content")) == "", F.col("content"))).alias("stored"))
    stored = stored.join(bad, (stored.prompt_key == bad.prompt_key) & (stored.stored == bad._c), "left").select(stored.prompt_key, F.when(F.col("_bad"), None).otherwise(F.col("stored")).alias("stored"))
    t = registry.join(stored, "prompt_key", "left")
    return t.select("prompt_key", F.coalesce("stored", "default_content").alias("content"), F.when(F.col("stored").isNotNull(), "stored").otherwise("default").alias("origin"))


def render(template: Column, values: dict[str, Column]) -> Column:
    """{token} replaced by values in one pass: what a value holds is not replaced again. Null values leave their token."""
    parts = F.split(template, r"(?=\{[A-Za-z_]+\})|(?<=\})")
    pick = lambda p: F.coalesce(*[F.when(p == "{" + k + "}", v) for k, v in values.items()], p)
    return F.array_join(F.transform(parts, pick), "")


def escape_xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def config_xml(settings: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row, xml: settings by category (without prompts) and the active suggestions. Both tables are of a few rows."""
    e = escape_xml
    line = F.concat(F.lit('    <setting key="'), e(F.col("config_key")), F.lit('">'), e(F.coalesce("config_value", F.lit(""))), F.lit("</setting>"))
    by = settings.where("category <> 'prompt'").groupBy("category").agg(F.array_sort(F.collect_list(F.struct("config_key", line.alias("line"))))["line"].alias("lines"))
    group = F.concat(F.lit('  <category name="'), e(F.col("category")), F.lit('">\n'), F.array_join("lines", "\n"), F.lit("\n  </category>"))
    one = by.agg(F.array_join(F.array_sort(F.collect_list(F.struct("category", group.alias("text"))))["text"], "\n").alias("a"))
    item = F.concat(F.lit("  <suggestion>"), e(F.col("label")), F.lit("</suggestion>"))
    two = suggestions.where("is_active").agg(F.array_join(F.array_sort(F.collect_list(F.struct("sort_order", "id", item.alias("text"))))["text"], "\n").alias("b"))
    return one.crossJoin(two).select(F.concat(F.lit("<config>\n"), F.concat_ws("\n", "a", "b"), F.lit("\n</config>")).alias("xml"))


def corpus_stats(chunks: DataFrame, oversize: int = 2000) -> DataFrame:
    n = F.length("text")
    return chunks.agg(
        F.count("*").alias("chunks"), F.countDistinct("file_name").alias("files"), F.count_if(F.coalesce("section_header", F.lit("")) == "").alias("without_section"),
        F.count_if(F.col("content_type") == "table").alias("tables"), F.round(F.avg(n), 2).alias("avg_length"), F.max(n).cast("long").alias("max_length"), F.count_if(n > oversize).alias("oversize"),
    )
