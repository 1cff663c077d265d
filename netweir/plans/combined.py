"""All ways of deciding on the same windows side by side, TCP abuse along flows, and records as SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from netweir.operators import detectors as op
from netweir.operators import segments
from netweir.sources import sinks, tables
from netweir.sources.lineage import folder

from .detectors import CONFORMAL, FEATURES, pvalues
from .registry import query, r6
from .views_sql import ATTACKS, PACKETS


@query(f"""
WITH {CONFORMAL}, r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY p, feature) AS r FROM p), d AS (SELECT idx, count(*) FILTER (p <= 0.05) AS hits, min(p) <= 0.05 AS any_channel, min(p) <= 0.05 / 4 AS bonferroni, avg(1 / greatest(p, 1e-12)) >= 20 AS evalue, min(4 * p / r) <= 0.1 AS stepped, round(min(4 * p / r), 9) AS alpha_star FROM r GROUP BY idx),
c AS (SELECT idx, 0.5 - atan(avg(0.5 * tan((0.5 - least(greatest(p, 1e-12), 1 - 1e-12)) * pi()))) / pi() AS acat FROM p GROUP BY idx),
g AS (SELECT d.*, acat, v.victim, v.attack, CASE WHEN hits >= 2 THEN true WHEN hits = 0 THEN false END AS edge FROM d JOIN c USING (idx) JOIN vectors v USING (idx)),
h AS (SELECT *, coalesce(last_value(edge IGNORE NULLS) OVER (PARTITION BY victim ORDER BY idx), false) AS gate FROM g)
SELECT idx, victim, attack, any_channel, bonferroni, evalue, stepped, round(acat, 6) AS acat, gate, CAST(any_channel AS INT) + CAST(bonferroni AS INT) + CAST(evalue AS INT) + CAST(stepped AS INT) + CAST(gate AS INT) AS votes, CAST(bonferroni AS INT) + CAST(evalue AS INT) + CAST(stepped AS INT) >= 2 OR (gate AND any_channel) AS detected FROM h
""")
def ensemble_rules(spark, sf_dir):
    """Any channel, Bonferroni, e-value, step-up, Cauchy and a gate with hysteresis, from one set of conformal p-values.

    The gate of a victim opens when two channels hit and shuts when none does.  Two of the three corrected rules decide, or the gate
    with any channel.
    """
    p = pvalues(spark, sf_dir)
    stepped = op.step_up(p, ["idx"], "p", "feature", 0.1).select("idx", F.col("rejected").alias("stepped"))
    wide = p.groupBy("idx").pivot("feature", FEATURES[:4]).agg(F.first("p"))
    ps = [F.col(f) for f in FEATURES[:4]]
    hits = sum(((x <= 0.05).cast("int") for x in ps), F.lit(0))
    evalue = sum((1 / F.greatest(x, F.lit(1e-12)) for x in ps), F.lit(0.0)) / 4
    d = wide.select("idx", hits.alias("hits"), (F.least(*ps) <= 0.05).alias("any_channel"), (F.least(*ps) <= 0.05 / 4).alias("bonferroni"), (evalue >= 20).alias("evalue"), op.acat(ps).alias("acat")).join(stepped, "idx")
    v = d.join(tables.vectors(spark, sf_dir).select("idx", "victim", "attack"), "idx")
    along = Window.partitionBy("victim").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    g = v.withColumn("gate", F.coalesce(F.last(F.when(F.col("hits") >= 2, True).when(F.col("hits") == 0, False), ignorenulls=True).over(along), F.lit(False)))
    n = lambda *cols: sum((F.col(c).cast("int") for c in cols), F.lit(0))
    return g.select("idx", "victim", "attack", "any_channel", "bonferroni", "evalue", "stepped", r6("acat"), "gate", n("any_channel", "bonferroni", "evalue", "stepped", "gate").alias("votes"), ((n("bonferroni", "evalue", "stepped") >= 2) | (F.col("gate") & F.col("any_channel"))).alias("detected"))


#: Numbers and windows of segments, which the given packets lack.
SEGMENTS = f"""{PACKETS}, sg AS (SELECT event_id, ts, src % 20 AS a, dst % 10 AS b, flags, length, CASE event_id % 4 WHEN 0 THEN 1000 WHEN 1 THEN (event_id * 1500) % 4294967296 ELSE (event_id * 2654435761) % 4294967296 END AS seq, CASE event_id % 3 WHEN 0 THEN 77777 ELSE (event_id * 40503) % 4294967296 END AS ack, CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 50 WHEN 2 THEN 1500 WHEN 3 THEN 1200 ELSE 8192 END AS win FROM packets WHERE proto = 6)"""
LIMITS = segments.Limits(same_seq=1, seq_jumps=4, same_ack=1, ack_jumps=2, same_window=3, zero_windows=2)


@query(f"""
WITH {SEGMENTS}, l AS (SELECT *, coalesce(lag(seq) OVER w, 0) AS ls, coalesce(last_value(CASE WHEN flags & 16 = 16 THEN ack END IGNORE NULLS) OVER (PARTITION BY a, b ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS la, coalesce(lag(win) OVER w, 0) AS lw FROM sg WINDOW w AS (PARTITION BY a, b ORDER BY ts, event_id)),
d AS (SELECT *, ls <> 0 OR la <> 0 AS k, flags & 16 = 16 AS f, ((seq - ls + 2147483648 + 4294967296) % 4294967296) - 2147483648 AS ds, ((ack - la + 2147483648 + 4294967296) % 4294967296) - 2147483648 AS da FROM l),
t AS (SELECT *, k AND seq = ls AS t1, k AND NOT ds BETWEEN -65536 AND 65536 + length AS t2, k AND f AND ack = la AS t3, k AND f AND NOT da BETWEEN -65536 AND 131072 AS t4, k AND win = lw AS t5, win = 0 AS t6, win > 0 AND win < 100 AS t7 FROM d),
c AS (SELECT *, {", ".join(f"count(*) FILTER (t{i}) OVER (PARTITION BY a, b ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c{i}" for i in range(1, 8))} FROM t)
SELECT event_id, ls AS last_seq, la AS last_ack, concat_ws(',', CASE WHEN t1 AND c1 > 1 THEN 'same_seq' END, CASE WHEN t2 AND c2 > 4 THEN 'seq_jump' END, CASE WHEN t3 AND c3 > 1 THEN 'same_ack' END, CASE WHEN t4 AND c4 > 2 THEN 'ack_jump' END, CASE WHEN t5 AND c5 > 3 THEN 'same_window' END, CASE WHEN t6 AND c6 > 2 THEN 'zero_window' END, CASE WHEN t7 AND c7 > 2 THEN 'tiny_window' END, CASE WHEN win >= 100 AND win < 2000 AND lw < 2000 THEN 'small_window' END) AS abuses FROM c
""")
def segment_abuse(spark, sf_dir):
    """Eight kinds of abuse along every flow's segments, wrap-around included."""
    e = F.col("event_id")
    wrap = 1 << 32
    p = tables.packets(spark, sf_dir).filter("proto = 6")
    seq = F.when(e % 4 == 0, 1000).when(e % 4 == 1, (e * 1500) % wrap).otherwise((e * 2654435761) % wrap)
    win = F.when(e % 7 == 0, 0).when(e % 7 == 1, 50).when(e % 7 == 2, 1500).when(e % 7 == 3, 1200).otherwise(8192)
    s = p.select("event_id", "ts", (F.col("src") % 20).alias("a"), (F.col("dst") % 10).alias("b"), "flags", "length", seq.alias("seq"), F.when(e % 3 == 0, 77777).otherwise((e * 40503) % wrap).alias("ack"), win.alias("win"))
    return segments.abuses(s, ["a", "b"], ["ts", "event_id"], LIMITS).select("event_id", "last_seq", "last_ack", "abuses")


@query(f"""
WITH {ATTACKS} SELECT 'INSERT INTO attacks (attack_id, target, attack_type, severity, is_active, mitigation_ms) VALUES ' || string_agg('(' || attack_id || ', ' || target || ', ''' || attack_type || ''', ''' || replace(severity, '''', '''''') || ''', ' || CASE WHEN is_active THEN 'TRUE' ELSE 'FALSE' END || ', ' || coalesce(CAST(mitigation_ms AS VARCHAR), 'NULL') || ')', ', ' ORDER BY attack_id) || ';' AS statement
FROM attacks GROUP BY attack_id // 100
""")
def attack_statements(spark, sf_dir):
    """Attack records exported as SQL, a hundred ids in a statement, written as text and read again."""
    a = tables.attacks(spark, sf_dir).select("attack_id", "target", "attack_type", "severity", "is_active", "mitigation_ms")
    sinks.export_sql(a, "attacks", path := folder(spark), F.floor(F.col("attack_id") / 100), ["attack_id"])
    return spark.read.text(path, lineSep="\n").withColumnRenamed("value", "statement")
