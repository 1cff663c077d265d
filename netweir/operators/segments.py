"""Abuse of TCP by sequence and acknowledgement numbers and windows, along each flow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACK = 16
#: How far numbers may go back, and how far acknowledgements may go ahead, without being a jump.
BACK, AHEAD_SEQ, AHEAD_ACK = 65_536, 65_536, 131_072
TINY_MOST = 2


@dataclass(frozen=True)
class Limits:
    """How often each may happen in a flow; windows under ``tiny`` and ``small`` bytes.  The defaults are fixed values."""

    same_seq: int = 150
    seq_jumps: int = 45
    same_ack: int = 150
    ack_jumps: int = 45
    same_window: int = 150
    zero_windows: int = 5
    tiny: int = 100
    small: int = 2000


def signed(new: Column, old: Column) -> Column:
    """The difference of two numbers of 32 bits that wrap around, from -2^31 to 2^31 - 1."""
    half = 1 << 31
    return F.pmod(new - old + half, F.lit(1 << 32)) - half


def abuses(segments: DataFrame, keys: list[str], order: list[str], limits: Limits = Limits()) -> DataFrame:
    """``segments`` (flags, length, seq, ack, win) with last_seq, last_ack and abuses, the names of what each one is part of.

    A flow's state is what its earlier segments left: the last sequence number and window, and the last acknowledgement
    of a segment with the ACK flag; before any it is zero, and then only windows are judged.  A limit is passed by the
    segment after as many; counts run along the flow, ordered by ``order`` (time, then something unique).
    """
    along = Window.partitionBy(*keys).orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    acked = F.col("flags").bitwiseAND(ACK) == ACK
    s = segments.withColumns({
        "last_seq": F.coalesce(F.lag("seq").over(along), F.lit(0)),
        "last_ack": F.coalesce(F.last(F.when(acked, F.col("ack")), ignorenulls=True).over(before), F.lit(0)),
        "_last_win": F.coalesce(F.lag("win").over(along), F.lit(0)),
    })
    known = (F.col("last_seq") != 0) | (F.col("last_ack") != 0)
    step, ack_step = signed(F.col("seq"), F.col("last_seq")), signed(F.col("ack"), F.col("last_ack"))
    tests = {
        "same_seq": (known & (F.col("seq") == F.col("last_seq")), limits.same_seq),
        "seq_jump": (known & ~step.between(-BACK, AHEAD_SEQ + F.col("length")), limits.seq_jumps),
        "same_ack": (known & acked & (F.col("ack") == F.col("last_ack")), limits.same_ack),
        "ack_jump": (known & acked & ~ack_step.between(-BACK, AHEAD_ACK), limits.ack_jumps),
        "same_window": (known & (F.col("win") == F.col("_last_win")), limits.same_window),
        "zero_window": (F.col("win") == 0, limits.zero_windows),
        "tiny_window": ((F.col("win") > 0) & (F.col("win") < limits.tiny), TINY_MOST),
    }
    s = s.withColumns({f"_{name}": test for name, (test, _) in tests.items()})
    over = [F.when(F.col(f"_{name}") & (F.count_if(F.col(f"_{name}")).over(upto) > most), name) for name, (_, most) in tests.items()]
    small = F.when((F.col("win") >= limits.tiny) & (F.col("win") < limits.small) & (F.col("_last_win") < limits.small), "small_window")
    return s.withColumn("abuses", F.concat_ws(",", *over, small)).drop("_last_win", *[f"_{name}" for name in tests])
