"""Attacks from opening to closing, over a table and over a stream of the same windows."""

from pyspark.sql import functions as F

from netweir.sources import tables
from netweir.sources.lineage import folder, written
from netweir.streaming import lifecycle as op

from .registry import query
from .views_sql import PACKETS

#: Hours instead of seconds, as the given tables have them.
STALE_MS, CALM = 24 * 3_600_000, 3
ATTACKS = f"""{PACKETS}, h AS (SELECT dst, CAST(epoch_ms(date_trunc('hour', ts)) AS BIGINT) AS ms, CAST(sum(length) AS DOUBLE) AS value, bool_or(attack) AS hot FROM packets GROUP BY 1, 2),
s AS (SELECT *, last_value(CASE WHEN hot THEN ms END IGNORE NULLS) OVER (PARTITION BY dst ORDER BY ms) AS h0 FROM h),
c AS (SELECT *, count(*) FILTER (NOT hot) OVER (PARTITION BY dst, h0 ORDER BY ms) AS calm FROM s WHERE h0 IS NOT NULL),
g AS (SELECT dst, h0, max(value) FILTER (hot) AS value, min(ms) FILTER (NOT hot AND calm = {CALM} AND ms <= h0 + {STALE_MS}) AS ended FROM c GROUP BY 1, 2),
n AS (SELECT *, lead(h0) OVER (PARTITION BY dst ORDER BY h0) AS nxt, (SELECT max(ms) FROM h) AS fin FROM g),
k AS (SELECT *, CASE WHEN ended IS NOT NULL AND (nxt IS NULL OR ended < nxt) THEN ended WHEN nxt > h0 + {STALE_MS} OR (nxt IS NULL AND fin > h0 + {STALE_MS}) THEN h0 + {STALE_MS} END AS closed FROM n),
b AS (SELECT *, CAST(coalesce(lag(closed IS NOT NULL) OVER (PARTITION BY dst ORDER BY h0), true) AS INT) AS fresh FROM k),
a AS (SELECT *, sum(fresh) OVER (PARTITION BY dst ORDER BY h0) AS attack FROM b)
SELECT dst, min(h0) AS opened_ms, max(closed) AS closed_ms, max(value) AS peak, count(*) AS windows, CASE WHEN max(ended) = max(closed) THEN 'ended' ELSE 'stale' END AS reason FROM a GROUP BY dst, attack HAVING max(closed) IS NOT NULL"""


def windows(spark, sf_dir):
    h = tables.packets(spark, sf_dir).groupBy("dst", F.date_trunc("hour", "ts").cast("timestamp").alias("w"))
    return h.agg(F.sum("length").cast("double").alias("value"), F.bool_or("attack").alias("hot"))


@query(f"WITH {ATTACKS}")
def attack_lifecycles(spark, sf_dir):
    return op.attacks_of(windows(spark, sf_dir), stale_ms=STALE_MS, calm=CALM)


@query(f"WITH {ATTACKS}")
def attack_lifecycle_stream(spark, sf_dir):
    """The windows as a stream of ten-day pieces, closed by calm or by timers, and what it wrote."""
    source, target, marks = folder(spark), folder(spark), folder(spark)
    rows = written(windows(spark, sf_dir))
    third = F.floor(F.dayofmonth("w") / 11)
    for k in range(3):
        rows.filter(third == k).repartition(1).write.mode("append").parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, op.PROVIDER)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        closed = op.attack_stream(stream, stale_ms=STALE_MS, calm=CALM)
        closed.writeStream.format("parquet").option("path", target).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(op.CLOSED).parquet(target)
