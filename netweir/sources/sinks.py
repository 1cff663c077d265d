"""Sinks: append-only roll-ups, retention, exports and baseline snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_rollup(rollup: DataFrame, path: str, day: str = "ts") -> None:
    """Append a roll-up, partitioned by day so that retention drops whole folders."""
    rollup.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)


def retained(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days."""
    return rows.filter(F.col(ts) >= now - F.make_interval(days=F.lit(days)))


def capped(rows: DataFrame, keys: list[str], newest: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each key: the store's limit on samples."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(newest)))).filter(F.col("_r") <= n).drop("_r")


def prune(spark: SparkSession, path: str, now: str, days: int, target: str) -> None:
    """Write what retention leaves of a partitioned table to ``target``; only folders of live days are read."""
    live = spark.read.parquet(path).filter(F.col("day") >= F.date_sub(F.lit(now).cast("date"), days))
    live.write.mode("overwrite").partitionBy("day").parquet(target)


def export(rows: DataFrame, path: str, form: str = "json") -> None:
    """JSON lines or CSV with a header."""
    w = rows.write.mode("overwrite")
    w.json(path) if form == "json" else w.option("header", True).csv(path)


def exposition(rows: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Text exposition lines of a metric, ``name{label="x"} value``."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return rows.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def snapshot_baselines(baselines: DataFrame, keys: list[str], path: str) -> None:
    """Keyed baselines as JSON documents that ``restored_baselines`` reads again."""
    baselines.select(*keys, F.to_json(F.struct(*[c for c in baselines.columns if c not in keys])).alias("state")).write.mode("overwrite").parquet(path)


def restored_baselines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    t = spark.read.parquet(path)
    return t.select(*[c for c in t.columns if c != "state"], F.from_json("state", schema).alias("s")).select(*[c for c in t.columns if c != "state"], "s.*")


def literal(column: str, kind: str) -> Column:
    """A value as SQL writes it: quotes are doubled, a missing one is NULL."""
    c = F.col(column)
    if kind == "boolean":
        out = F.when(c, "TRUE").when(~c, "FALSE")
    elif kind in ("string", "date", "timestamp", "timestamp_ntz"):
        out = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit("NULL"))


def statements(rows: DataFrame, table: str, batch: Column, order: list[str]) -> DataFrame:
    """statement: an INSERT of all rows of a ``batch`` into ``table``, in order.  A batch is a group, so it must be bounded."""
    kinds = dict(rows.dtypes)
    values = F.concat(F.lit("("), F.concat_ws(", ", *[literal(c, kinds[c]) for c in rows.columns]), F.lit(")"))
    head = F.lit(f"INSERT INTO {table} ({', '.join(rows.columns)}) VALUES ")
    each = rows.select(batch.alias("_batch"), F.struct(*order, values.alias("_values")).alias("_row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_row")), lambda r: r["_values"]), ", ")
    return each.groupBy("_batch").agg(F.concat(head, body, F.lit(";")).alias("statement")).drop("_batch")


def export_sql(rows: DataFrame, table: str, path: str, batch: Column, order: list[str]) -> None:
    """A folder of text files of statements, for a database to load."""
    statements(rows, table, batch, order).write.text(path)
