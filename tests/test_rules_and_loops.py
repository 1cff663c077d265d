"""Rules against brute force, stages that use nothing up early, closed loops, and attacks closed by timers."""

import random

import pytest
from pyspark.sql import functions as F

from netweir.operators import cascade, regimes, rules
from netweir.streaming import lifecycle

PACKET = "event_id long, proto int, src long, dst long, src_port int, dst_port int, length int, ttl int, flags int"
RULE = "rule_id long, priority long, action string, proto int, src long, src_len int, dst long, dst_len int, src_port_lo int, src_port_hi int, dst_port_lo int, dst_port_hi int, length_lo int, length_hi int, ttl_lo int, ttl_hi int, flags_mask int, flags_value int"


def fits(r, p):
    proto, src, dst, ranges = p[1], p[2], p[3], p[4:8]
    if r[3] is not None and r[3] != proto:
        return False
    for value, net, n in ((src, r[4], r[5]), (dst, r[6], r[7])):
        n = 32 if n is None else n
        if net is not None and n and (value is None or value >> (32 - n) != net >> (32 - n)):
            return False
    for value, lo, hi in zip(ranges, r[8:16:2], r[9:17:2], strict=True):
        if (lo is not None or hi is not None) and (value is None or value < (lo or 0) or (hi is not None and value > hi)):
            return False
    return not (r[16] and proto == 6 and p[8] & r[16] != r[17] & r[16])


def test_first_match(spark):
    rng = random.Random(2)
    maybe = lambda x, share=0.4: x if rng.random() < share else None
    packets = [(i, rng.choice([1, 6, 17, 47]), maybe(rng.randrange(1 << 32) if i % 2 else (10 << 24) + rng.randrange(4096), 0.95), rng.randrange(300), rng.randrange(65536), rng.randrange(2000), rng.randrange(1500), rng.randrange(256), rng.randrange(64)) for i in range(1500)]
    table = []
    for i in range(250):
        lo, plo = rng.randrange(1800), rng.randrange(60000)
        port, sport, size, ttl = maybe((lo, lo + rng.choice([0, 5, 300, 5000]))), maybe((plo, plo + rng.choice([10, 9000])), 0.2), maybe((100, rng.randrange(100, 1500)), 0.2), maybe((30, None), 0.1)
        mask = maybe(rng.randrange(1, 64), 0.2)
        ends = [e for pair in (sport, port, size, ttl) for e in (pair or (None, None))]
        table.append((i, rng.randrange(40), rng.choice(["DROP", "ALLOW"]), maybe(rng.choice([1, 6, 17])), maybe((10 << 24) + rng.randrange(4096)), maybe(rng.choice([0, 8, 20, 24, 32])), maybe(rng.randrange(300), 0.3), None, *ends, mask, None if mask is None else rng.randrange(64)))
    out = rules.first_match(spark.createDataFrame(packets, PACKET), spark.createDataFrame(table, RULE))
    want = {}
    for p in packets:
        best = min(((r[1], r[0], r[2]) for r in table if fits(r, p)), default=(None, None, "ALLOW"))
        want[p[0]] = best[1:]
    assert {r["event_id"]: (r["rule_id"], r["action"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "HashJoin" in plan


def test_no_rules_and_wide_rules(spark):
    p = spark.createDataFrame([(1, 6, 5, 5, 1, 1, 1, 1, 2)], PACKET)
    assert rules.first_match(p, spark.createDataFrame([], RULE)).first()["action"] == "ALLOW"
    wide = spark.createDataFrame([(7, 1, "DROP", 0, 60000), (8, 0, "DENY", 500, 60000)], "rule_id int, priority int, action string, dst_port_lo int, dst_port_hi int")
    assert tuple(rules.first_match(p, wide).select("rule_id", "action").first()) == (7, "DROP")


def test_many_rules_of_one_key(spark):
    """Rules share one key, or two; the first that holds stands at every place of the runs that are tried."""
    n = 100
    packets = spark.createDataFrame([(i, 6, i % 7, 5, 1, 1, i, 1, 2) for i in range(n + 20)], PACKET)
    wide = [(1000 + i, i, "DROP", i, None, None) for i in range(n)]
    own = [(2000 + i, i - (i % 3 == 0), "DENY", i, 6, 3) for i in range(0, n, 2)]
    table = spark.createDataFrame(wide + own, "rule_id long, priority long, action string, length_lo int, proto int, src long")
    table = table.withColumn("length_hi", F.col("length_lo"))
    want = {}
    for i in range(n + 20):
        fit = [(r[1], r[0], r[2]) for r in wide + own if r[3] == i and (r[5] is None or r[5] == i % 7)]
        want[i] = min(fit, default=(None, None, "ALLOW"))[1:]
    got = {r["event_id"]: (r["rule_id"], r["action"]) for r in rules.first_match(packets, table).collect()}
    assert got == want and any(a == "DENY" for _, a in got.values())


def test_live(spark):
    table = spark.sql("SELECT * FROM VALUES (1, true, NULL), (2, false, NULL), (3, true, timestamp '2024-01-01'), (4, NULL, timestamp '2025-01-01') t(rule_id, enabled, expires_at)")
    assert [r[0] for r in rules.live(table, F.lit("2024-06-01").cast("timestamp")).orderBy("rule_id").collect()] == [1, 4]


def test_stages_use_nothing_up_early(spark):
    rows = [(i, i, "a", "bad" if i < 5 else "good", "x") for i in range(10)] + [(10, 10, None, "good", "y"), (11, 11, None, "good", "y")]
    packets = spark.createDataFrame(rows, "event_id long, t long, src string, kind string, _reason_of string")
    stages = [cascade.Check("content", F.col("kind") == "bad"), cascade.Limit("rate", F.lit(True), ("src",), 3), cascade.Limit("second", F.col("src") == "a", ("src",), 2)]
    got = {r["event_id"]: r["drop_reason"] for r in cascade.admitted(packets, stages, ("t", "event_id"), ["event_id"]).collect()}
    assert got == {**{i: "content" for i in range(5)}, 5: None, 6: None, 7: "second", 8: "rate", 9: "rate", 10: None, 11: None}


def test_known_and_bypass(spark):
    rows = [(1, "s", True), (2, "s", False), (3, "t", False), (4, "t", True), (5, "t", False), (6, "w", False)]
    packets = spark.createDataFrame(rows, "event_id long, src string, syn boolean")
    stages = [cascade.Bypass(F.col("src") == "w"), cascade.Known("spoofed", F.lit(True), F.col("syn"), ("src",))]
    got = {r["event_id"]: r["drop_reason"] for r in cascade.admitted(packets, stages, ("event_id",), ["event_id"]).collect()}
    assert got == {1: None, 2: None, 3: "spoofed", 4: None, 5: None, 6: None}


def test_update_allowed():
    every = [(d, a) for d in (False, True) for a in (False, True)]
    allowed = lambda regime: [(d, a) for d, a in every if regimes.update_allowed(regime, d, a, False)]
    assert allowed("frozen_audit") == []
    assert allowed("conjunction_benign") == [(False, False)]
    assert allowed("production_episode") == [(False, False), (False, True)]
    assert allowed("attack_skip") == [(False, False), (True, False)]
    assert not any(regimes.update_allowed(r, False, False, True) for r in regimes.REGIMES)
    with pytest.raises(ValueError, match="unknown regime"):
        regimes.update_allowed("no-such-regime", False, False, False)


def test_freeze_and_recovery():
    guard, loop = regimes.Guard(rate=0.5, window=100.0, count=3, recovery=50.0), regimes.Loop()
    for t in range(20):
        loop.update(10.0, 0.5)
        loop.watch(float(t), guard)
    assert loop.frozen_at is None
    for t, x in ((20, 40.0), (21, 200.0), (22, 900.0)):
        loop.update(x, 0.5)
        loop.watch(float(t), guard)
    assert loop.frozen_at == 22.0
    loop.recover(71.0, True, guard)
    assert loop.frozen_at == 22.0
    loop.recover(72.0, False, guard)
    assert loop.frozen_at == 22.0, "no recovery while an anomaly is active"
    loop.recover(72.0, True, guard)
    assert loop.frozen_at is None and loop.changes == 0


def test_decisions_gate_their_own_baseline(spark):
    """A ramp that is taken for benign is learned; one that is detected is not."""
    rows = [("v", i, 100.0 + i % 5, False, i < 40) for i in range(50)] + [("v", 50 + i, 400.0, i % 2 == 0, False) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, i long, x double, attack boolean, train boolean")
    out = regimes.closed_loops(df, ["k"], "i", F.col("i"), F.col("x"), F.col("attack"), F.col("train"), theta=4.0)
    last = out.orderBy(F.desc("i")).first()
    assert last["detected_frozen_audit"] and last["detected_conjunction_benign"] and last["detected_production_episode"]
    assert not last["detected_attack_skip"], "updates by label alone take the ramp in"
    assert out.filter("updated_frozen_audit").count() == 40


def test_attacks_close_by_timer_and_survive_restarts(spark, tmp_path):
    rng, rows = random.Random(1), []
    for d in range(5):
        t = 0
        for _ in range(80):
            t += rng.choice([60, 60, 60, 120, 400, 900])
            rows.append((d, t, float(rng.randrange(100)), rng.random() < 0.3))
    rows.append((77, 30, 5.0, True))  # nothing is heard of it again: only a timer can close it
    df = spark.createDataFrame(rows, "dst long, s long, value double, hot boolean").select("dst", F.timestamp_seconds("s").alias("w"), "value", "hot")
    end, name = max(r[1] for r in rows), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, lifecycle.PROVIDER)
    try:
        for k in range(3):
            part = df.filter((F.unix_seconds("w") > (end * k // 3 if k else -1)) & (F.unix_seconds("w") <= end * (k + 1) // 3))
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
            lifecycle.attack_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, lifecycle.attacks_of(df).collect()))
    assert (77, 30_000, 630_000, 5.0, 1, "stale") in got and {r[-1] for r in got} == {"stale", "ended"}


def test_lifecycle_tells_the_store_only_changes():
    """Rows stream in as they are; a destination without an attack costs one question to the store."""
    from unittest.mock import MagicMock

    from pyspark.sql import Row

    cycle, store = lifecycle.Lifecycle(), MagicMock()
    cycle.init(store)
    state = store.getValueState.return_value
    state.get.return_value = None
    calm = [Row(ms=i, value=1.0, hot=False) for i in range(3)]
    assert list(cycle.handleInputRows((1,), iter(calm), None)) == [] and not state.clear.called and not state.update.called
    state.get.return_value = (10, 20, 5.0, 2, 0)
    out = list(cycle.handleInputRows((1,), iter([Row(ms=30 + i, value=1.0, hot=False) for i in (2, 0, 1)]), None))
    assert [tuple(r) for r in out] == [(1, 10, 32, 5.0, 2, "ended")] and state.clear.call_count == 1 and store.deleteTimer.call_count == 1


def test_bands(spark, monkeypatch):
    """No table holds a key's rules in a row, and packets that a band of rules matched are not tried again."""
    seen, real = [], rules.written
    monkeypatch.setattr(rules, "written", lambda df: seen.append(real(df)) or seen[-1])
    monkeypatch.setattr(rules, "BAND", 4, raising=False)
    monkeypatch.setattr(rules, "HELD", 40, raising=False)
    rng = random.Random(5)
    packets = [(i, rng.choice([1, 6, 17]), i % 7, 5, i * 50, i % 90, i, 1, 2) for i in range(1200)]
    table = []
    for i in range(300):
        a, b = rng.randrange(60000), rng.randrange(1200)
        table.append((i, i // 3, "DROP", rng.choice([None, 6]), None, None, None, None, a, a + rng.choice([3, 900, 9000, 30000]), None, None, *((b, b + 40) if i % 2 else (None, None)), None, None, None, None))
    out = rules.first_match(spark.createDataFrame(packets, PACKET), spark.createDataFrame(table, RULE)).collect()
    want = {p[0]: min(((r[1], r[0]) for r in table if fits(r, p)), default=(None, None))[1] for p in packets}
    assert {r["event_id"]: r["rule_id"] for r in out} == want and None in want.values()
    assert not any(f.dataType.typeName() == "array" for df in seen for f in df.schema)
    left = [df.count() for df in seen if "_at" in df.columns and "_rank" not in df.columns]
    assert left[0] == 1200 and len(left) > 2 and left == sorted(left, reverse=True) and left[-1] < 600


def test_scores_at_a_threshold(spark):
    """A score of exactly 4.5: thirty windows of mean 72 and deviation 24, then one of 180, in whichever order they come."""
    from netweir.operators import subnets

    rng, rows = random.Random(3), []
    for subnet in range(60):
        xs = [60] * 24 + [120] * 6
        rng.shuffle(xs)
        rows += [(subnet, subnet, i, n, n * 7, n * 11, "fit") for i, n in enumerate(xs)] + [(subnet, subnet, 99, 180, 180 * 7, 180 * 11, "test")]
    wide = spark.createDataFrame([*rows, (99, 99, 99, 1, 1, 1, "test")], "subnet long, host long, win long, packets long, bytes long, sources long, part string")
    got = {r["subnet"]: r["score"] for r in subnets.scores(wide, wide.select("subnet", "host", "win", "packets"), "subnet", "host", "win").filter("part = 'test'").collect()}
    assert got.pop(99) is None and set(got.values()) == {4.5}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bands_are_joined_by_their_own_size(spark, monkeypatch):
    """Keys, which are many for each packet, and what bands found are never broadcast; rules are, up to so many."""
    seen, real = [], rules.written
    monkeypatch.setattr(rules, "written", lambda df: seen.append(_plan(df)) or real(df))
    monkeypatch.setattr(rules, "BAND", 4)
    monkeypatch.setattr(rules, "HELD", 40)
    packets = [(i, 6, i % 7, 5, i * 60, i % 90, i, 1, 2) for i in range(1200)]
    table = [(i, i // 3, "DROP", 6 if i % 2 else None, None, None, None, None, i * 200, i * 200 + 300, None, None, None, None, None, None, None, None) for i in range(300)]
    out = rules.first_match(spark.createDataFrame(packets, PACKET), spark.createDataFrame(table, RULE))
    want = {p[0]: min(((r[1], r[0]) for r in table if fits(r, p)), default=(None, None))[1] for p in packets}
    assert {r["event_id"]: r["rule_id"] for r in out.collect()} == want and None in want.values()
    joins = [line for plan in [*seen, _plan(out)] for line in plan.splitlines() if "Join " in line]
    held = [line for line in joins if "BroadcastHashJoin" in line]
    assert held and all("[_key" in line and "BuildRight" in line for line in held)
    for key in ("_key", "_at", "_rank"):
        assert any(f"SortMergeJoin [{key}" in line for line in joins)


@pytest.mark.parametrize("name", ["verdict_cascade", "layer_statistics"])
def test_packets_are_not_broadcast(spark, sf_dir, monkeypatch, name):
    """Tables that have a row for each packet or address meet packets by a merge, whatever their files' size."""
    from netweir import plans

    seen, real = [], cascade.written
    monkeypatch.setattr(cascade, "written", lambda df: seen.append(_plan(df)) or real(df))
    seen.append(_plan(plans.QUERIES[name](spark, sf_dir)))
    joins = [line for plan in seen for line in plan.splitlines() if "Join " in line]
    assert any("SortMergeJoin [ip" in line for line in joins)
    assert not any(f"BroadcastHashJoin [{key}" in line for line in joins for key in ("event_id", "ip", "_at"))
