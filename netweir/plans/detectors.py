"""Detectors, votes, classification and evaluation queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from netweir.functions.traffic import jsd
from netweir.operators import detectors as op
from netweir.operators import evaluation as ev
from netweir.operators import synthesis
from netweir.operators.windows import flow_shares
from netweir.sources import tables

from .recursions import SERIES, SLOTS, ewma_sql, series, tiers
from .registry import query, r6
from .views_sql import PACKETS, VECTORS

FEATURES = [f"f{j}" for j in range(8)]


def matrix(spark, sf_dir):
    return tables.vectors(spark, sf_dir).withColumn("train", (F.col("idx") % 2 == 0) & ~F.col("attack"))


M = VECTORS + ", m AS (SELECT *, idx % 2 = 0 AND NOT attack AS train FROM vectors), long AS (UNPIVOT m ON f0, f1, f2, f3, f4, f5, f6, f7 INTO NAME feature VALUE x)"
POT = f"""{M}, cut AS (SELECT feature, quantile_cont(x, 0.98) AS cut, stddev_pop(x) AS sd FROM long WHERE train GROUP BY feature),
fit AS (SELECT feature, cut, CASE WHEN count(o) > 2 THEN greatest(0.5 * avg(o) * (avg(o) ** 2 / (var_pop(o) + 1e-8) + 1), 0.01) ELSE greatest(max(sd), 0.1) END AS scale
        FROM (SELECT long.feature, cut, sd, CASE WHEN x > cut THEN x - cut END AS o FROM long JOIN cut USING (feature) WHERE train) GROUP BY feature, cut),
pot AS (SELECT idx, greatest(0, max((x - cut) / scale)) AS score FROM long JOIN fit USING (feature) WHERE NOT train GROUP BY idx)"""
TAILS = f"""{M}, c AS (SELECT feature, x, count(*) FILTER (train) AS k FROM long GROUP BY 1, 2), n AS (SELECT feature, sum(k) AS n FROM c GROUP BY 1),
t AS (SELECT feature, x, greatest(up / n, 1 / (n + 1)) AS l, greatest((n - up + k) / n, 1 / (n + 1)) AS r FROM (SELECT feature, x, k, sum(k) OVER (PARTITION BY feature ORDER BY x) AS up FROM c) JOIN n USING (feature)),
sk AS (SELECT feature, sign(avg((x - m) ** 3)) AS sk FROM (SELECT feature, x, avg(x) OVER (PARTITION BY feature) AS m FROM long WHERE train) GROUP BY feature),
u AS (SELECT idx, -ln(l) AS ul, -ln(r) AS ur, CASE WHEN sk > 0 THEN -ln(r) WHEN sk < 0 THEN -ln(l) ELSE -ln(l) - ln(r) END AS us FROM long JOIN t USING (feature, x) JOIN sk USING (feature) WHERE NOT train)"""


@query(f"WITH {POT} SELECT idx, round(score, 6) + 0.0 AS score FROM pot")
def pot_scores(spark, sf_dir):
    return op.peaks_over_threshold(op.long_form(matrix(spark, sf_dir), FEATURES)).select("idx", (F.round("score", 6) + 0.0).alias("score"))


@query()
def dspot_scores(spark, sf_dir):
    return op.drifting_peaks(op.long_form(matrix(spark, sf_dir), FEATURES, ("idx", "victim", "train"))).select("idx", r6("score"))


@query(f"WITH {TAILS} SELECT idx, round(sum(greatest(ul, ur, us)), 6) AS score FROM u GROUP BY idx")
def ecod_scores(spark, sf_dir):
    return op.tail_scores(op.long_form(matrix(spark, sf_dir), FEATURES)).select("idx", r6("score"))


@query(f"WITH {TAILS} SELECT idx, round(sum(greatest(us, (ul + ur) / 2)), 6) AS score FROM u GROUP BY idx")
def copod_scores(spark, sf_dir):
    return op.tail_scores(op.long_form(matrix(spark, sf_dir), FEATURES), "copod").select("idx", r6("score"))


@query(f"""
WITH {M}, s AS (SELECT feature, min(x) AS lo, (max(x) - min(x)) / 10 AS width, count(*) AS n FROM long WHERE train GROUP BY 1),
b AS (SELECT feature, idx, train, x, lo, width, n, CAST(least(greatest(floor((x - lo) / width), 0), 9) AS INTEGER) AS bin FROM long JOIN s USING (feature)),
d AS (SELECT feature, bin, -log2(count(*) / (n * width) + 0.1) AS s FROM b WHERE train GROUP BY feature, bin, n, width), w AS (SELECT feature, CASE WHEN count(*) < 10 THEN -log2(0.1) ELSE max(s) END AS worst FROM d GROUP BY 1)
SELECT idx, round(sum(CASE WHEN x < lo - 0.5 * width OR x > lo + 10.5 * width THEN worst ELSE coalesce(s, -log2(0.1)) END), 6) AS score FROM b JOIN w USING (feature) LEFT JOIN d USING (feature, bin) WHERE NOT train GROUP BY idx
""")
def hbos_scores(spark, sf_dir):
    return op.histogram_scores(op.long_form(matrix(spark, sf_dir), FEATURES)).select("idx", r6("score"))


@query()
def loda_scores(spark, sf_dir):
    return op.loda_scores(matrix(spark, sf_dir), FEATURES).select("idx", r6("score"))


@query()
def iforest_scores(spark, sf_dir):
    return op.isolation_forest(matrix(spark, sf_dir), FEATURES).select("idx", r6("score"))


@query()
def deep_forest_scores(spark, sf_dir):
    return op.deep_isolation_forest(matrix(spark, sf_dir), FEATURES).select("idx", r6("score"))


@query()
def inne_scores(spark, sf_dir):
    return op.nearest_hyperspheres(matrix(spark, sf_dir), FEATURES).select("idx", r6("score"))


@query()
def subspace_scores(spark, sf_dir):
    """Smoothed residual energy outside the first four components."""
    return op.subspace_scores(matrix(spark, sf_dir), FEATURES, k=4).select("idx", r6("score"))


@query(f"""
WITH RECURSIVE {SERIES}, {SLOTS}, {ewma_sql('', 0.15)}, z1 AS (SELECT label, w, z AS a FROM z),
{ewma_sql('hour_slot', 0.05).replace('s AS (SELECT', 's2 AS (SELECT', 1).replace('FROM s WHERE', 'FROM s2 WHERE').replace('JOIN s ON', 'JOIN s2 s ON').replace('e AS (SELECT label', 'e2 AS (SELECT label', 1).replace('FROM e JOIN', 'FROM e2 e JOIN').replace('z AS (SELECT', 'z2 AS (SELECT', 1).replace('FROM e)', 'FROM e2)')},
{ewma_sql('week_slot', 0.01).replace('s AS (SELECT', 's3 AS (SELECT', 1).replace('FROM s WHERE', 'FROM s3 WHERE').replace('JOIN s ON', 'JOIN s3 s ON').replace('e AS (SELECT label', 'e3 AS (SELECT label', 1).replace('FROM e JOIN', 'FROM e3 e JOIN').replace('z AS (SELECT', 'z3 AS (SELECT', 1).replace('FROM e)', 'FROM e3)')},
v AS (SELECT label, w, a, z2.z AS b, z3.z AS c FROM z1 JOIN z2 USING (label, w) JOIN z3 USING (label, w)),
t AS (SELECT *, CAST(abs(a) >= 2 AS INT) + CAST(abs(b) >= 2 AS INT) + CAST(abs(c) >= 2 AS INT) AS tiers, greatest(abs(a), abs(b), abs(c)) AS max_z FROM v),
d AS (SELECT *, tiers >= 2 OR (tiers = 1 AND max_z >= 2.5) AS detected FROM t)
SELECT label, w, tiers, round(max_z, 6) AS max_z, detected,
    CASE WHEN NOT detected THEN 0 WHEN tiers >= 3 THEN CASE WHEN max_z >= 12 THEN 4 WHEN max_z >= 9 THEN 3 WHEN max_z >= 6 THEN 2 ELSE 1 END WHEN tiers = 2 THEN CASE WHEN max_z >= 15 THEN 3 WHEN max_z >= 10 THEN 2 ELSE 1 END WHEN max_z >= 15 THEN 2 ELSE 1 END AS level,
    round(CASE WHEN detected THEN least(CASE WHEN tiers >= 3 THEN 0.99 WHEN tiers = 2 THEN 0.9 ELSE 0.75 END * least(1 + 0.1 * (max_z - 2) / 2, 1.5), 1) ELSE 0 END, 6) AS confidence FROM d
""")
def tier_vote(spark, sf_dir):
    t = tiers(spark, sf_dir)
    vote = op.tier_vote([F.col(f"z_{n}") for n in ("immediate", "hourly", "weekly")], 2.0)
    return t.select("label", "w", *[(F.round(c, 6) if n in ("max_z", "confidence") else c).alias(n) for n, c in vote.items()])


def mix_sql(p: str, q: str) -> str:
    parts = [(f"greatest({p}{i}, 1e-10)", f"greatest({q}{i}, 1e-10)") for i in range(4)]
    kl = lambda k: " + ".join(f"{x[k]} * ln({x[k]} / (({x[0]} + {x[1]}) / 2))" for x in parts)
    return f"least(greatest((({kl(0)}) + ({kl(1)})) / 2 / ln(2), 0), 1)"


@query(f"""
WITH {PACKETS}, d AS (SELECT CAST(ts AS DATE) AS w, {", ".join(f"count(*) FILTER ({c}) / count(*) AS p{i}" for i, c in enumerate(("proto = 6", "proto = 17", "proto = 1", "proto = 47")))} FROM packets GROUP BY 1),
b AS (SELECT *, {", ".join(f"avg(p{i}) OVER (ORDER BY w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS q{i}" for i in range(4))} FROM d)
SELECT w, round({mix_sql("p", "q")}, 6) AS jsd, {mix_sql("p", "q")} >= 0.15 AS alarm FROM b WHERE q0 IS NOT NULL
""")
def protocol_divergence(spark, sf_dir):
    """Divergence of a day's protocol shares from those of the week before; a row per day is ordered."""
    n = F.count("*")
    d = tables.packets(spark, sf_dir).groupBy(F.to_date("ts").alias("w")).agg(*[(F.count_if(F.col("proto") == p) / n).alias(f"p{i}") for i, p in enumerate((6, 17, 1, 47))])
    w = Window.orderBy("w").rowsBetween(-7, -1)
    b = d.withColumns({f"q{i}": F.avg(f"p{i}").over(w) for i in range(4)}).filter("q0 IS NOT NULL")
    x = jsd([F.col(f"p{i}") for i in range(4)], [F.col(f"q{i}") for i in range(4)])
    return b.select("w", F.round(x, 6).alias("jsd"), (x >= 0.15).alias("alarm"))


CONFORMAL = f"""{M}, s AS (SELECT idx, train, feature, abs(x) AS s FROM long WHERE feature IN ('f0', 'f1', 'f2', 'f3')),
p AS (SELECT a.idx, a.feature, (1.0::DOUBLE + (SELECT count(*) FROM s b WHERE b.train AND b.feature = a.feature AND b.s >= a.s)) / (1.0::DOUBLE + (SELECT count(*) FROM s b WHERE b.train AND b.feature = a.feature)) AS p FROM s a WHERE NOT a.train)"""


def pvalues(spark, sf_dir):
    s = op.long_form(matrix(spark, sf_dir), FEATURES[:4]).select("idx", "train", "feature", F.abs("x").alias("s"))
    return op.conformal(s, "s", "train", ["feature"]).filter("NOT train").select("idx", "feature", "p")


@query(f"WITH {CONFORMAL} SELECT idx, feature, round(p, 9) AS p FROM p")
def conformal_pvalues(spark, sf_dir):
    return pvalues(spark, sf_dir).select("idx", "feature", F.round("p", 9).alias("p"))


@query(f"""
WITH {CONFORMAL} SELECT idx, min(p) <= 0.05 / 4 AS bonferroni, avg(1 / greatest(p, 1e-12)) >= 1 / 0.05 AS evalue,
    round(0.5 - atan(avg(0.5 * tan((0.5 - least(greatest(p, 1e-12), 1 - 1e-12)) * pi()))) / pi(), 6) AS acat FROM p GROUP BY idx
""")
def combined_decisions(spark, sf_dir):
    """Bonferroni, e-value and Cauchy combinations of four channels."""
    w = pvalues(spark, sf_dir).groupBy("idx").pivot("feature", FEATURES[:4]).agg(F.first("p"))
    ps = [F.col(f) for f in FEATURES[:4]]
    return w.select("idx", (F.least(*ps) <= 0.05 / 4).alias("bonferroni"), (sum((1 / F.greatest(p, F.lit(1e-12)) for p in ps), F.lit(0.0)) / 4 >= 1 / 0.05).alias("evalue"), F.round(op.acat(ps), 6).alias("acat"))


@query(f"""
WITH {CONFORMAL}, r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY p, feature) AS r FROM p)
SELECT idx, round(min(4 * p / r), 6) AS alpha_star, max(feature) FILTER (r = 1) AS channel, min(4 * p / r) <= 0.1 AS rejected FROM r GROUP BY idx
""")
def step_up(spark, sf_dir):
    return op.step_up(pvalues(spark, sf_dir), ["idx"], "p", "feature", 0.1).select("idx", r6("alpha_star"), "channel", "rejected")


def snapshot(spark, sf_dir):
    """Engine-profile features of every (dst, day), with z-scores against the destination's other days."""
    p = tables.packets(spark, sf_dir).withColumn("w", F.to_date("ts"))
    c = lambda x: F.count_if(x)
    n = F.count("*")
    flag = lambda m, v: F.col("flags").bitwiseAND(F.lit(m)) == v
    g = p.groupBy("dst", "w").agg(n.alias("packets"), F.sum("length").alias("bytes"), F.count_distinct("src").alias("sources"), F.count_distinct(F.struct("src", "proto")).alias("flows"), c(flag(18, 2)).alias("syn"), c(flag(16, 16)).alias("ack"), c(flag(4, 4)).alias("rst"), (100.0 * c(F.col("proto") == 6) / n).alias("tcp"), (100.0 * c(F.col("proto") == 17) / n).alias("udp"), (100.0 * c(F.col("proto") == 1) / n).alias("icmp"))
    g = g.join(flow_shares(p, ["dst", "w"], ["src", "proto"]).select("dst", "w", F.col("max_flow_fraction").alias("max_flow")), ["dst", "w"])
    g = g.withColumns({"bytes_per_packet": F.col("bytes") / F.col("packets"), "syn_ack_ratio": F.col("syn") * 100.0 / F.greatest("ack", F.lit(1)), "rst_syn_ratio": F.col("rst") * 100.0 / F.greatest("syn", F.lit(1)), "per_flow": F.col("packets") / F.col("flows"), "duration": F.lit(0.0)})
    w = Window.partitionBy("dst")
    return g.withColumns({f"z_{k}": F.round(4 * (F.col(k) - F.avg(k).over(w)) / F.greatest(F.coalesce(F.stddev_pop(k).over(w), F.lit(0.0)), F.lit(0.25)), 6) for k in Z})


Z = ("packets", "bytes", "sources", "flows", "syn", "ack", "rst", "icmp")
V = ("packets", "bytes_per_packet", "sources", "syn", "syn_ack_ratio", "rst_syn_ratio", "tcp", "udp", "icmp", "max_flow", "duration", "per_flow")
UP = lambda z, full: f"least(z_{z} / {full}, 1)"
POINTS = {
    "syn_flood": f"CASE WHEN z_syn > 3 THEN 0.3 * {UP('syn', 10)} ELSE 0 END + CASE WHEN syn_ack_ratio < 50 AND syn > 1000 THEN 0.25 * (1 - syn_ack_ratio / 100) ELSE 0 END + CASE WHEN z_sources > 2 THEN 0.2 * {UP('sources', 8)} ELSE 0 END + CASE WHEN bpp < 100 AND bpp > 0 THEN 0.15 ELSE 0 END + CASE WHEN tcp > 80 THEN 0.1 ELSE 0 END",
    "udp_flood": f"CASE WHEN udp > 60 THEN 0.2 * udp / 100 ELSE 0 END + CASE WHEN z_packets > 4 THEN 0.25 * {UP('packets', 10)} ELSE 0 END + CASE WHEN bpp > 0 AND bpp < 200 THEN 0.2 * (1 - bpp / 200) ELSE 0 END + CASE WHEN z_sources > 3 THEN 0.2 * {UP('sources', 8)} ELSE 0 END + CASE WHEN max_flow < 10 THEN 0.15 * (1 - max_flow / 10) ELSE 0 END",
    "amplification": "CASE WHEN udp > 60 THEN 0.2 * udp / 100 ELSE 0 END + CASE WHEN bpp > 500 THEN 0.3 * least((bpp - 500) / 1000, 1) ELSE 0 END + CASE WHEN z_bytes > z_packets * 1.5 AND z_bytes > 3 THEN 0.2 ELSE 0 END + CASE WHEN sources > 0 AND packets / sources > 100 THEN 0.15 * least(packets / sources / 1000, 1) ELSE 0 END + CASE WHEN max_flow > 20 THEN 0.15 * max_flow / 100 ELSE 0 END",
    "icmp_flood": f"CASE WHEN icmp > 30 THEN 0.5 * icmp / 100 ELSE 0 END + CASE WHEN z_icmp > 3 THEN 0.3 * {UP('icmp', 10)} ELSE 0 END + CASE WHEN z_packets > 3 THEN 0.2 * {UP('packets', 10)} ELSE 0 END",
    "slowloris": "CASE WHEN z_flows > z_packets AND z_flows > 3 THEN 0.25 ELSE 0 END + CASE WHEN per_flow < 10 AND per_flow > 0 THEN 0.25 * (1 - per_flow / 10) ELSE 0 END + CASE WHEN tcp > 80 THEN 0.1 ELSE 0 END + CASE WHEN z_flows > z_bytes * 2 AND z_flows > 3 THEN 0.1 ELSE 0 END",
    "volumetric": f"CASE WHEN z_bytes > 4 THEN 0.4 * {UP('bytes', 12)} ELSE 0 END + CASE WHEN z_packets > 4 THEN 0.3 * {UP('packets', 12)} ELSE 0 END + CASE WHEN z_bytes > 3 AND z_packets > 3 AND least(z_bytes, z_packets) / greatest(z_bytes, z_packets) > 0.5 THEN 0.2 * least(z_bytes, z_packets) / greatest(z_bytes, z_packets) ELSE 0 END + CASE WHEN tcp < 70 AND udp < 70 THEN 0.1 ELSE 0 END",
    "ack_flood": f"CASE WHEN z_ack > 4 AND tcp > 80 THEN 0.5 * {UP('ack', 10)} + CASE WHEN z_syn < 2 THEN 0.3 ELSE 0 END ELSE 0 END",
    "rst_flood": f"CASE WHEN z_rst > 4 AND rst_syn_ratio > 200 THEN 0.5 * {UP('rst', 10)} + CASE WHEN rst_syn_ratio > 500 THEN 0.3 ELSE 0 END ELSE 0 END",
}


@query(f"""
WITH {PACKETS}, p AS (SELECT *, CAST(ts AS DATE) AS w FROM packets),
g AS (SELECT dst, w, count(*) AS packets, sum(length) AS bytes, count(DISTINCT src) AS sources, count(DISTINCT (src, proto)) AS flows, count(*) FILTER (flags & 18 = 2) AS syn, count(*) FILTER (flags & 16 = 16) AS ack, count(*) FILTER (flags & 4 = 4) AS rst,
      100.0 * count(*) FILTER (proto = 6) / count(*) AS tcp, 100.0 * count(*) FILTER (proto = 17) / count(*) AS udp, 100.0 * count(*) FILTER (proto = 1) / count(*) AS icmp FROM p GROUP BY 1, 2),
fl AS (SELECT dst, w, 100.0 * max(c) / sum(c) AS max_flow FROM (SELECT dst, w, src, proto, count(*) AS c FROM p GROUP BY ALL) GROUP BY 1, 2),
x AS (SELECT *, bytes / packets AS bpp, syn * 100.0 / greatest(ack, 1) AS syn_ack_ratio, rst * 100.0 / greatest(syn, 1) AS rst_syn_ratio, packets / flows AS per_flow,
      {", ".join(f"round(4 * ({k} - avg({k}) OVER (PARTITION BY dst)) / greatest(coalesce(stddev_pop({k}) OVER (PARTITION BY dst), 0), 0.25), 6) AS z_{k}" for k in Z)} FROM g JOIN fl USING (dst, w)),
s AS (SELECT dst, w, {", ".join(f"round(least({v}, 1), 9) AS {k}" for k, v in POINTS.items())} FROM x),
r AS (SELECT dst, w, kind, score, row_number() OVER (PARTITION BY dst, w ORDER BY score DESC, list_position({list(POINTS)}, kind)) AS r FROM (UNPIVOT s ON {", ".join(POINTS)} INTO NAME kind VALUE score)),
q AS (SELECT dst, w, max(score) FILTER (r = 1) AS top, max(kind) FILTER (r = 1) AS kind, string_agg(kind, ',' ORDER BY r) FILTER (r <= 3) AS top3 FROM r GROUP BY 1, 2)
SELECT dst, w, CASE WHEN top >= 0.3 THEN q.kind ELSE 'unknown' END AS kind, round(top, 6) AS score, CASE WHEN top >= 0.6 THEN 'high' WHEN top >= 0.4 THEN 'medium' ELSE 'low' END AS confidence,
    CAST(1 + (SELECT count(*) FROM r WHERE r.dst = q.dst AND r.w = q.w AND r.r > 1 AND r.score >= 0.3 AND r.score >= 0.6 * top) AS INTEGER) AS vectors, top3 FROM q
""")
def attack_classification(spark, sf_dir):
    s = snapshot(spark, sf_dir)
    scores = {k: F.round(x, 9) for k, x in op.attack_scores({k: F.col(k) for k in V}, {k: F.col(f"z_{k}") for k in Z}).items()}
    # named once, or every use would spell out its whole sum
    named = s.select("dst", "w", *[x.alias(k) for k, x in scores.items()])
    v = op.classified({k: F.col(k) for k in scores})
    return named.select("dst", "w", v.alias("v")).select("dst", "w", "v.kind", F.round("v.score", 6).alias("score"), "v.confidence", "v.vectors", "v.top3")


AUC = """c AS (SELECT feature, s, count(*) AS n, count(*) FILTER (attack) AS pos FROM scored GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY s) - n + (n + 1) / 2 AS rank FROM c)
SELECT feature, round((sum(rank * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))), 6) AS auc FROM k GROUP BY feature"""


def judged(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    return v.unpivot(["idx", "attack"], FEATURES, "feature", "x").select("idx", "attack", "feature", F.round("x", 1).alias("s"))


JUDGED = VECTORS + ", scored AS (SELECT idx, attack, feature, round(x, 1) AS s FROM (UNPIVOT vectors ON f0, f1, f2, f3, f4, f5, f6, f7 INTO NAME feature VALUE x))"


@query(f"WITH {JUDGED}, {AUC}")
def roc_auc(spark, sf_dir):
    return ev.auc(judged(spark, sf_dir), ["feature"], "s", "attack").select("feature", r6("auc"))


@query(f"WITH {JUDGED.replace('round(x, 1) AS s', 'CAST(-idx AS DOUBLE) AS s')}, {AUC.replace('SELECT feature, round(', 'SELECT feature, round(abs(0.5 - ').replace('(sum(n) - sum(pos))), 6)', '(sum(n) - sum(pos)))) + 0.5, 6)')}")
def clock_null(spark, sf_dir):
    """Separability that the order of rows alone gives."""
    s = judged(spark, sf_dir).withColumn("s", -F.col("idx").cast("double"))
    return ev.auc(s, ["feature"], "s", "attack").select("feature", F.round(F.abs(0.5 - F.col("auc")) + 0.5, 6).alias("auc"))


@query(f"""
WITH {JUDGED}, t AS (SELECT feature, quantile_cont(s, 0.95) FILTER (NOT attack) AS threshold, count(*) FILTER (NOT attack) AS benign, count(*) FILTER (attack) AS attacks FROM scored GROUP BY 1),
o AS (SELECT feature, idx, attack FROM scored JOIN t USING (feature) WHERE s > threshold), e AS (SELECT feature, count(*) AS episodes FROM (SELECT feature, idx - lag(idx) OVER (PARTITION BY feature ORDER BY idx) AS gap FROM o WHERE NOT attack) WHERE gap IS NULL OR gap > 3 GROUP BY 1),
h AS (SELECT feature, count(*) AS hits FROM o WHERE attack GROUP BY 1)
SELECT feature, round(threshold, 6) AS threshold, round(100.0 * coalesce(hits, 0) / greatest(attacks, 1), 6) AS detection, round(1000.0 * coalesce(episodes, 0) / greatest(benign, 1), 6) AS episodes_per_1000 FROM t LEFT JOIN e USING (feature) LEFT JOIN h USING (feature)
""")
def detection_at_rate(spark, sf_dir):
    return ev.at_false_positive_rate(judged(spark, sf_dir), ["feature"], "idx", "s", "attack", 0.05, 3).select("feature", *map(r6, ("threshold", "detection", "episodes_per_1000")))


@query(f"""
WITH {JUDGED}, s AS (SELECT *, CASE WHEN idx % 3 = 0 THEN 'calib' ELSE 'test' END AS part FROM scored WHERE feature = 'f1'), t AS (SELECT quantile_cont(s, 0.9) AS threshold FROM s WHERE part = 'calib')
SELECT round(threshold, 6) AS threshold, round(count(*) FILTER (s > threshold AND NOT attack) / count(*) FILTER (NOT attack), 6) AS fpr, round(count(*) FILTER (s > threshold AND attack) / count(*) FILTER (attack), 6) AS dr FROM s, t WHERE part = 'test' GROUP BY threshold
""")
def held_out_operating_point(spark, sf_dir):
    s = judged(spark, sf_dir).filter("feature = 'f1'").withColumn("part", F.when(F.col("idx") % 3 == 0, "calib").otherwise("test"))
    return ev.held_out_rates(s, "part", "s", "attack", 0.1).select(*map(r6, ("threshold", "fpr", "dr")))


@query(f"WITH {JUDGED} SELECT least(greatest(ceil(quantile_cont(abs(s) * 20, 0.97) * 2) / 2, 4), 20) AS theta FROM scored")
def theta_calibration(spark, sf_dir):
    return ev.theta(judged(spark, sf_dir).withColumn("z", F.abs("s") * 20), "z")


@query(f"""
WITH {PACKETS}, g AS (SELECT dst, count(*) FILTER (attack) AS k, count(*) AS n FROM packets GROUP BY 1), c AS (SELECT *, k / n AS p FROM g)
SELECT dst, k, n, round(greatest(((p + 3.8416 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 0), 6) + 0.0 AS low, round(least(((p + 3.8416 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 1), 6) AS high FROM c
""")
def wilson_intervals(spark, sf_dir):
    return ev.share_interval(tables.packets(spark, sf_dir), ["dst"], F.col("attack")).select("dst", "k", "n", (F.round("low", 6) + 0.0).alias("low"), r6("high"))


@query(f"WITH {JUDGED.replace('round(x, 1)', 'x')}, w AS (PIVOT (SELECT idx, feature, s FROM scored) ON feature IN ('f0', 'f1') USING first(s)) SELECT count(*) FILTER (f0 > 0.1 AND NOT f1 > 0.1) AS b, count(*) FILTER (NOT f0 > 0.1 AND f1 > 0.1) AS c FROM w")
def mcnemar_counts(spark, sf_dir):
    return ev.mcnemar(tables.vectors(spark, sf_dir), F.col("f0") > 0.1, F.col("f1") > 0.1).select("b", "c")


@query(f"""
WITH {PACKETS}, g AS (SELECT dst, count(*) FILTER (attack) AS hits, count(*) AS n FROM packets GROUP BY 1),
d AS (SELECT draw, hits, n, CAST('0x' || md5('7:' || dst || ':' || draw)[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS u FROM g, (SELECT unnest(range(1, 501)) AS draw)),
r AS (SELECT draw, 100.0 * sum(t * hits) / greatest(sum(t * n), 1) AS rate FROM (SELECT *, {" + ".join(f"CAST(u > {x!r}::DOUBLE AS INT)" for x in ev.POISSON)} AS t FROM d) GROUP BY draw)
SELECT round((SELECT 100.0 * sum(hits) / sum(n) FROM g), 6) AS rate, round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high FROM r
""")
def cluster_bootstrap(spark, sf_dir):
    g = tables.packets(spark, sf_dir).groupBy("dst").agg(F.count_if("attack").alias("hits"), F.count("*").alias("n"))
    return ev.cluster_bootstrap(g, "dst", "hits", "n").select(*map(r6, ("rate", "low", "high")))


@query(f"""
WITH {PACKETS}, g AS (SELECT label, count(*) / 20000.0 AS p FROM packets GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, label) AS i, count(*) OVER () AS m FROM g)
SELECT label, round(p, 6) AS p, round(least(p * m, 1), 6) AS bonferroni, round(least(max(p * (m - i + 1)) OVER (ORDER BY i), 1), 6) AS holm FROM r
""")
def holm_adjusted(spark, sf_dir):
    g = tables.packets(spark, sf_dir).groupBy("label").agg((F.count("*") / 20000.0).alias("p"))
    return ev.holm(g, "label", "p").select("label", *map(r6, ("p", "bonferroni", "holm")))


@query(f"WITH {PACKETS}, g AS (SELECT label, sum(length) AS s, count(*) AS n FROM packets GROUP BY 1) SELECT label, round(s / n, 6) AS mean, round((sum(s) OVER () - s) / (sum(n) OVER () - n), 6) AS others FROM g")
def leave_one_out(spark, sf_dir):
    return ev.leave_one_out(tables.packets(spark, sf_dir), "label", "length").select("label", r6("mean"), r6("others"))


@query(f"""
WITH {PACKETS}, a AS (SELECT label AS path, avg(length) AS x FROM packets WHERE label <> 'view' GROUP BY 1), b AS (SELECT label AS path, CASE WHEN label = 'click' THEN avg(length) ELSE avg(length) + 1 END AS y FROM packets WHERE label <> 'error' GROUP BY 1)
SELECT path, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN abs(x - y) <= 1e-9 * greatest(abs(x), abs(y), 1) THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path)
""")
def result_diff(spark, sf_dir):
    g = tables.packets(spark, sf_dir).groupBy(F.col("label").alias("path")).agg(F.avg("length").alias("value"))
    return ev.tree_difference(g.filter("path <> 'view'"), g.filter("path <> 'error'").withColumn("value", F.when(F.col("path") == "click", F.col("value")).otherwise(F.col("value") + 1)))


@query(f"""
WITH {SERIES}, b AS (SELECT label, w, CAST(n AS DOUBLE) AS n, CAST(bytes AS DOUBLE) AS bytes FROM series WHERE i <= 10)
SELECT label, w, step, round(n * pow(1.05, step), 6) AS n, round(bytes * pow(1.05, step), 4) AS bytes FROM b, (SELECT unnest(range(0, 12)) AS step)
""")
def slow_ramps(spark, sf_dir):
    b = series(spark, sf_dir).filter("i <= 10").select("label", "w", F.col("n").cast("double").alias("n"), F.col("bytes").cast("double").alias("bytes"))
    return op.ramps(b, 0.05, 12, ["n", "bytes"]).select("label", "w", F.col("step").cast("long").alias("step"), r6("n"), F.round("bytes", 4).alias("bytes"))


#: Benign windows of every victim with the features that attacks change; an hour stands for a second.
BENIGN = f"""{PACKETS}, bw AS (SELECT dst, date_trunc('hour', ts) AS w, CAST(count(*) AS DOUBLE) AS packets_per_sec, CAST(sum(length) AS DOUBLE) AS bytes_per_sec, CAST(count(DISTINCT src) AS DOUBLE) AS flows_per_sec, CAST(avg(ttl) AS DOUBLE) AS flow_duration_avg, CAST(count(DISTINCT src % 8) AS DOUBLE) AS unique_dst_ips, CAST(count(DISTINCT dst_port) AS DOUBLE) AS unique_dst_ports,
    count(*) FILTER (proto = 6) / count(*) AS tcp_ratio, count(*) FILTER (proto = 17) / count(*) AS udp_ratio, count(*) FILTER (src < 100) / count(*) AS dir_ratio FROM packets GROUP BY 1, 2 HAVING NOT bool_or(attack))"""


def benign_windows(spark, sf_dir):
    one = lambda c: F.count_if(c) / F.count("*")
    d = lambda c: c.cast("double")
    g = tables.packets(spark, sf_dir).groupBy("dst", F.date_trunc("hour", "ts").alias("w")).agg(F.bool_or("attack").alias("hit"), d(F.count("*")).alias("packets_per_sec"), d(F.sum("length")).alias("bytes_per_sec"), d(F.count_distinct("src")).alias("flows_per_sec"), F.avg("ttl").alias("flow_duration_avg"), d(F.count_distinct(F.col("src") % 8)).alias("unique_dst_ips"), d(F.count_distinct("dst_port")).alias("unique_dst_ports"), one(F.col("proto") == 6).alias("tcp_ratio"), one(F.col("proto") == 17).alias("udp_ratio"), one(F.col("src") < 100).alias("dir_ratio"))
    return g.filter("NOT hit").drop("hit")


@query(f"""
WITH {BENIGN}, k(kind, p, b, f, dur, ips, ports, tcp, udp, dir, dirx) AS (VALUES ('syn_flood', 8, 4, 1, 0.1, 6, 1, 0.94, 0.04, 0.85, 1), ('udp_flood', 9, 7, 1, 1, 1, 1, 0.08, 0.90, 0.92, 1), ('dns_amplification', 2.5, 9, 0.3, 1, 1, 1, 0.04, 0.96, NULL, 1), ('ntp_amplification', 3, 12, 0.2, 1, 1, 1, 0.02, 0.98, NULL, 1),
    ('slowloris', 1.1, 1.05, 4, 18, 1, 1, NULL, NULL, NULL, 0.9), ('fragment_flood', 4, 1.5, 0.8, 1, 1, 1, NULL, NULL, 0.88, 1), ('pulse_attack', 22, 18, 12, 1, 1, 1, NULL, NULL, NULL, 1), ('carpet_bomb', 1.2, 1, 40, 1, 3, 80, NULL, NULL, NULL, 1)),
x AS (SELECT dst, w, kind, packets_per_sec * p::DOUBLE AS packets_per_sec, bytes_per_sec * b::DOUBLE AS bytes_per_sec, flows_per_sec * f::DOUBLE AS flows_per_sec, flow_duration_avg * dur::DOUBLE AS flow_duration_avg, unique_dst_ips * ips::DOUBLE AS unique_dst_ips, unique_dst_ports * ports::DOUBLE AS unique_dst_ports, coalesce(tcp::DOUBLE, tcp_ratio) AS tcp_ratio, coalesce(udp::DOUBLE, udp_ratio) AS udp_ratio, coalesce(dir::DOUBLE, dir_ratio * dirx::DOUBLE) AS dir_ratio FROM bw, k)
SELECT dst, w, kind, {", ".join(f"round({c}, 6) AS {c}" for c in ("packets_per_sec", "bytes_per_sec", "flows_per_sec", "flow_duration_avg", "unique_dst_ips", "unique_dst_ports", "tcp_ratio", "udp_ratio", "dir_ratio"))}, round(unique_dst_ports * 1000 / (packets_per_sec + 1e-10), 6) AS dst_port_density FROM x
""")
def synthesized_attacks(spark, sf_dir):
    """Every benign window as each of eight attacks."""
    out = synthesis.synthesized(benign_windows(spark, sf_dir))
    return out.select("dst", "w", "kind", *map(r6, (*synthesis.FEATURES, "dst_port_density")))


@query(f"""
WITH {BENIGN}, x AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w) AS i FROM bw), r AS (SELECT dst, w, rate, CAST(step AS INTEGER) AS step, packets_per_sec * pow(1 + rate, step) AS packets_per_sec, flows_per_sec * pow(1 + rate, step) AS flows_per_sec, unique_dst_ports FROM x, (VALUES (0.05::DOUBLE, 60), (0.2, 25)) k(rate, cycles), LATERAL (SELECT unnest(range(cycles)) AS step) WHERE i = 1)
SELECT dst, w, rate, step, round(packets_per_sec, 4) AS packets_per_sec, round(flows_per_sec, 4) AS flows_per_sec, round(unique_dst_ports * 1000 / (packets_per_sec + 1e-10), 4) AS dst_port_density FROM r
""")
def ramped_attacks(spark, sf_dir):
    """The first benign window of every victim grown by a twentieth for sixty steps and by a fifth for twenty-five."""
    first = benign_windows(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("dst").orderBy("w"))).filter("i = 1").drop("i")
    both = [synthesis.ramped(first, rate, cycles).withColumn("rate", F.lit(rate)) for rate, cycles in ((0.05, 60), (0.2, 25))]
    return both[0].unionByName(both[1]).select("dst", "w", "rate", "step", *[F.round(c, 4).alias(c) for c in ("packets_per_sec", "flows_per_sec", "dst_port_density")])


@query(f"""
WITH {SERIES}, s AS (SELECT label, avg(bytes) FILTER (attack) AS a, avg(bytes) FILTER (NOT attack) AS b, quantile_cont(bytes, 0.95) AS p95, count(*) FILTER (attack) AS k, count(*) AS n FROM series GROUP BY 1)
SELECT label, k AS attacks, n AS windows, round(p95, 6) AS p95, CASE WHEN k < 3 THEN 'too_few' WHEN a > 1.5 * b THEN 'admitted' ELSE 'weak' END AS verdict FROM s
""")
def scenario_census(spark, sf_dir):
    a, b = F.avg(F.when(F.col("attack"), F.col("bytes"))), F.avg(F.when(~F.col("attack"), F.col("bytes")))
    g = series(spark, sf_dir).groupBy("label").agg(F.count_if("attack").alias("attacks"), F.count("*").alias("windows"), F.round(F.percentile("bytes", F.lit(0.95)), 6).alias("p95"), a.alias("a"), b.alias("b"))
    return g.withColumn("verdict", F.when(F.col("attacks") < 3, "too_few").when(F.col("a") > 1.5 * F.col("b"), "admitted").otherwise("weak")).drop("a", "b")
