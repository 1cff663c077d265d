"""Closed loops of detection and baseline update over the windows of every victim."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from netweir.operators import regimes as op
from netweir.sources import tables

from .registry import query, r6
from .views_sql import PACKETS

#: Hours with traffic of each victim; the first twenty train.
VICTIMS = f"""{PACKETS}, vh AS (SELECT dst, date_trunc('hour', ts) AS w, sum(length) AS bytes, bool_or(attack) AS attack FROM packets GROUP BY 1, 2),
victims AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w) AS i, CAST(epoch(w) AS DOUBLE) AS t FROM vh)"""
#: The same guard in Spark and SQL, wide enough for hours.
GUARD = op.Guard(rate=0.12, window=72 * 3600.0, count=2, recovery=96 * 3600.0)
THETA, ALPHA, TRAIN = 1.5, 0.15, 20

#: One step of a loop for a window x at t: what is scored, then decided, then updated, then watched.
SCORED = "CASE WHEN n < 10 THEN 0 ELSE least(greatest((x - m) / greatest(sqrt(v), CASE WHEN m > 50 THEN 0.02 * m ELSE 1 END), -100), 100) END"
MAY = "CASE regime WHEN 'frozen_audit' THEN false WHEN 'conjunction_benign' THEN NOT det AND NOT a WHEN 'production_episode' THEN NOT det ELSE NOT a END"
LOOPS = f"""
s AS (SELECT regime, dst, w, i, t, CAST(bytes AS DOUBLE) AS x, attack AS a, i <= {TRAIN} AS tr FROM victims, (VALUES ('frozen_audit'), ('conjunction_benign'), ('production_episode'), ('attack_skip')) r(regime)),
e AS (SELECT regime, dst, 0::BIGINT AS i, CAST(NULL AS TIMESTAMP) AS w, 0.0::DOUBLE AS z, false AS det, false AS upd, false AS frz, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v, 0 AS n, CAST(NULL AS DOUBLE) AS lst, CAST(NULL AS DOUBLE) AS since, 0 AS ch, CAST(NULL AS DOUBLE) AS fat FROM s WHERE i = 1
      UNION ALL
      SELECT regime, dst, i, w, z, det, upd, frz, m, v, n, m, since, ch, CASE WHEN fat IS NULL AND n >= 10 AND ch >= {GUARD.count} AND big THEN t ELSE fat END FROM (
        SELECT *, ch0 + CAST(big AS INT) AS ch FROM (
          SELECT *, fat IS NULL AND n >= 10 AND lst >= 1 AND abs(m - lst) / lst > {GUARD.rate} AS big FROM (
            SELECT * EXCLUDE (since0, ch1, lst0), CASE WHEN since0 IS NULL OR t - since0 > {GUARD.window} THEN t ELSE since0 END AS since, CASE WHEN since0 IS NULL OR t - since0 > {GUARD.window} THEN 0 ELSE ch1 END AS ch0, CASE WHEN since0 IS NULL OR t - since0 > {GUARD.window} THEN m ELSE lst0 END AS lst FROM (
              SELECT regime, dst, i, w, t, z, det, frz, upd, fat, since0, ch1, lst0, CASE WHEN NOT upd THEN m WHEN n = 0 THEN x ELSE m + {ALPHA} * (x - m) END AS m, CASE WHEN NOT upd THEN v WHEN n = 0 THEN 0 ELSE (1 - {ALPHA}) * (v + {ALPHA} * (x - m) * (x - m)) END AS v, n + CAST(upd AS INT) AS n FROM (
                SELECT *, NOT frz AND (tr OR {MAY}) AS upd FROM (
                  SELECT *, fat IS NOT NULL AS frz FROM (
                    SELECT * EXCLUDE (fat0, ch2, since1), CASE WHEN back THEN NULL ELSE fat0 END AS fat, CASE WHEN back THEN 0 ELSE ch2 END AS ch1, CASE WHEN back THEN NULL ELSE since1 END AS since0 FROM (
                      SELECT *, fat0 IS NOT NULL AND NOT det AND t - fat0 >= {GUARD.recovery} AS back FROM (
                        SELECT *, NOT tr AND abs(z) >= {THETA} AS det FROM (
                          SELECT *, {SCORED} AS z FROM (SELECT s.regime, s.dst, s.i, s.w, s.t, s.x, s.a, s.tr, e.m, e.v, e.n, e.lst AS lst0, e.since AS since1, e.ch AS ch2, e.fat AS fat0 FROM e JOIN s ON s.regime = e.regime AND s.dst = e.dst AND s.i = e.i + 1)))))))))))),
loops AS (SELECT * FROM e WHERE i > 0)"""


def victim_windows(spark, sf_dir):
    h = tables.packets(spark, sf_dir).groupBy("dst", F.date_trunc("hour", "ts").alias("w")).agg(F.sum("length").alias("bytes"), F.bool_or("attack").alias("attack"))
    return h.withColumn("train", F.row_number().over(Window.partitionBy("dst").orderBy("w")) <= TRAIN)


def loops(windows):
    return op.closed_loops(windows, ["dst"], "w", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "w") / 1e6, F.col("bytes"), F.col("attack"), F.col("train"), THETA, ALPHA, GUARD)


ARMS = list(op.REGIMES)


@query(f"""
WITH RECURSIVE {VICTIMS}, {LOOPS}
SELECT dst, w, {", ".join(f"round(max(CASE WHEN regime = '{r}' THEN z END), 6) AS z_{r}, bool_or(regime = '{r}' AND det) AS detected_{r}, bool_or(regime = '{r}' AND upd) AS updated_{r}, bool_or(regime = '{r}' AND frz) AS frozen_{r}" for r in ARMS)} FROM loops GROUP BY 1, 2
""")
def regime_loops(spark, sf_dir):
    """All four regimes over every victim's windows, side by side."""
    out = loops(victim_windows(spark, sf_dir))
    return out.select("dst", "w", *[c for r in ARMS for c in (r6(f"z_{r}"), f"detected_{r}", f"updated_{r}", f"frozen_{r}")])


@query(f"""
WITH RECURSIVE {VICTIMS}, {LOOPS}
SELECT regime, count(*) AS windows, round(count(*) FILTER (det AND attack) / count(*) FILTER (attack), 6) AS detection_rate, round(count(*) FILTER (det AND NOT attack) / count(*) FILTER (NOT attack), 6) AS false_rate, count(*) FILTER (upd) AS updates, count(*) FILTER (frz) AS frozen
FROM loops JOIN victims USING (dst, i) WHERE i > {TRAIN} GROUP BY regime
""")
def update_regimes(spark, sf_dir):
    """What each regime costs and catches: rates over test windows, windows that updated, windows frozen."""
    w = victim_windows(spark, sf_dir)
    return op.regime_summary(loops(w), w, ["dst"], "w", "attack", "train").select("regime", "windows", r6("detection_rate"), r6("false_rate"), "updates", "frozen")
