"""Gaps and islands: Markdown sections and Dockerfile instructions, for any table with a key and a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import text as X


def numbered_lines(df: DataFrame, key: str, content: str, split: str = "\n") -> DataFrame:
    """``key, lineno, line``: one row a line, numbered from 1; what follows the last line end counts only if it isn't empty."""
    rows = F.split(F.col(content), split, -1)
    rows = F.when(F.element_at(rows, -1) == "", F.slice(rows, 1, F.size(rows) - 1)).otherwise(rows)
    return df.select(key, F.posexplode(rows).alias("at", "line")).select(key, (F.col("at") + 1).alias("lineno"), "line")


def sections(lines: DataFrame, key: str, tokens: Column | None = None) -> DataFrame:
    """Markdown units of ``key, lineno, line``: ``key, ord, name, lineno, complexity, loc, acl, is_typed, nesting_depth, tokens``.

    A line that starts with ``#`` opens a section. Lines before the first one form ``# Introduction``. ``tokens``, an
    expression over ``content``, defaults to a quarter of the section's characters.
    """
    running = Window.partitionBy(key).orderBy("lineno").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("section", F.sum(F.when(F.col("line").startswith("#"), 1).otherwise(0)).over(running))
    rows = marked.groupBy(key, "section").agg(
        F.min("lineno").alias("lineno"),
        F.count("*").alias("n"),
        F.min_by("line", "lineno").alias("head"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )
    header = F.when(F.col("section") == 0, F.lit("# Introduction")).otherwise(F.col("head"))
    tokens = X.token_estimate(F.col("content")) if tokens is None else tokens
    rows = rows.withColumn("header", header).withColumn("tokens", tokens.cast("double")).withColumn("nesting_depth", X.header_depth(F.col("header")))
    return rows.select(
        key,
        F.col("section").cast("int").alias("ord"),
        X.strip(F.col("header")).alias("name"),
        F.when(F.col("section") == 0, 1).otherwise(F.col("lineno")).cast("int").alias("lineno"),
        (F.col("tokens") / 100.0).alias("complexity"),
        F.col("n").cast("int").alias("loc"),
        X.acl_markdown(F.col("tokens"), F.col("nesting_depth")).alias("acl"),
        F.lit(True).alias("is_typed"),
        "nesting_depth",
        F.col("tokens").cast("int").alias("tokens"),
    )


def instructions(lines: DataFrame, key: str, continues: Column | None = None) -> DataFrame:
    """Dockerfile units of ``key, lineno, line``: ``key, ord, name, lineno, complexity, loc, acl, is_typed, nesting_depth, content``.

    Blank and comment lines drop out first. A line whose stripped text ends with a backslash continues on the next
    one (``continues`` overrides that test); what still continues at the end of the file is dropped.
    """
    body = X.strip(F.col("line"))
    kept = lines.withColumn("body", body).where((F.col("body") != "") & ~F.col("body").startswith("#"))
    kept = kept.withColumn("more", F.col("body").endswith("\\") if continues is None else continues)
    order = Window.partitionBy(key).orderBy("lineno")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.when(F.coalesce(F.lag("more").over(order), F.lit(False)), 0).otherwise(1)
    grouped = kept.withColumn("opens", opens).withColumn("ord", F.sum("opens").over(running))
    rows = grouped.groupBy(key, "ord").agg(
        F.min("lineno").alias("lineno"),
        F.max("lineno").alias("last"),
        F.max_by("more", "lineno").alias("open"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )
    rows = rows.where(~F.col("open")).withColumn("name", X.instruction_name(F.col("content")))
    loc = F.col("last") - F.col("lineno") + 1
    cc = X.chained_commands(F.col("content")).cast("double")
    return rows.select(
        key,
        F.col("ord").cast("int").alias("ord"),
        "name",
        F.col("lineno").cast("int").alias("lineno"),
        cc.alias("complexity"),
        loc.cast("int").alias("loc"),
        X.acl_docker(cc, loc).alias("acl"),
        X.practice_ok(F.col("name"), F.col("content")).alias("is_typed"),
        F.lit(0).alias("nesting_depth"),
        "content",
    )


def follows_within(lines: DataFrame, key: str, first: Column, then: Column, ahead: int) -> DataFrame:
    """``key, lineno`` of lines where ``first`` holds and ``then`` holds on one of the next ``ahead`` lines."""
    order = Window.partitionBy(key).orderBy("lineno")
    marked = lines.withColumn("then_", then)
    hit = F.lit(False)
    for k in range(1, ahead + 1):
        hit = hit | F.coalesce(F.lead("then_", k).over(order), F.lit(False))
    return marked.withColumn("hit_", hit).where(first & F.col("hit_")).select(key, "lineno")
