"""Fill-in-the-middle transformation with relational units.

A text is tiled by units (code points, words or lines).  Matches are blocks of units: they are exploded with their
places, and a window sums their lengths; the units of just those blocks that a cut falls in are exploded and summed
as well, both are joined by the block of the unit's ordinal, and the offsets of a document are gathered in one row,
which cuts its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns whose matches, left to right, tile any text.
UNITS = {"code_point": r"(?s:.)", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}
#: Units of a block: a document of n units has n / BLOCK rows, and BLOCK rows for a cut.
BLOCK = 128
#: Marks of prefix, suffix and middle; of 100 documents this many are cut, and of those this many are spm.
P, S, M = "<P>", "<S>", "<M>"
CUT, SPM = 90, 20


def draws(ident: Column) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of ``1:`` and the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def planned(docs: DataFrame, ident: str, unit: str, cut: int, spm: int) -> DataFrame:
    """_id, _text, _k, _l (a key of 128 bits: equal rows share it), _n, _form, and the ordinals _first and _last of cuts."""
    text = F.coalesce("text", F.lit(""))
    n = F.length("_text") if unit == "code_point" else F.regexp_count("_text", F.lit(UNITS[unit]))
    base = docs.select(F.col(ident).alias("_id"), text.alias("_text"), F.xxhash64(F.lit(1), ident, text).alias("_k"), F.xxhash64(F.lit(2), ident, text).alias("_l"))
    h = draws(F.col("_id"))
    plain = (F.col("_text") == "") | F.col("_text").contains(P) | F.col("_text").contains(S) | F.col("_text").contains(M) | (h[2] % 100 >= cut)
    at = [x % (F.col("_n") + 1) for x in h[:2]]
    return base.withColumn("_n", n.cast("long")).withColumns({"_form": F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm"), "_first": F.least(*at), "_last": F.greatest(*at)})


def offsets(rows: DataFrame, unit: str, block: int = BLOCK) -> DataFrame:
    """_k, _l, _from, _to: the places in code points after the first ``_first`` and ``_last`` units of each text."""
    # a cut after k units lies in the block that holds unit k - 1
    of = lambda k: F.greatest(F.lit(0), F.floor((F.col(k) - 1) / block)).cast("int")
    asked = rows.withColumns({"_a": of("_first"), "_b": of("_last")})
    pieces = asked.select("_k", "_l", "_first", "_last", "_a", "_b", F.posexplode(F.regexp_extract_all("_text", F.lit(f"(?:{UNITS[unit]}){{1,{block}}}+"), F.lit(0))).alias("_block", "_piece"))
    hit = F.col("_block").isin(F.col("_a"), F.col("_b"))
    lengths = pieces.select("_k", "_l", "_block", F.length("_piece").cast("long").alias("_chars"), hit.alias("_hit"))
    # equal rows share a key, so a block counts once for each of them
    order = Window.partitionBy("_k", "_l").orderBy("_block")
    copies = F.count("*").over(order.rangeBetween(0, 0))
    before = F.expr("_sum div _copies") - F.col("_chars")
    summed = lengths.withColumns({"_sum": F.sum("_chars").over(order), "_copies": copies}).filter("_hit")
    starts = summed.select("_k", "_l", "_block", before.alias("_start")).dropDuplicates(["_k", "_l", "_block"])
    # the requests, each with the units of its block; sums begin before rows are shuffled, so no text travels
    request = lambda which, k, b: F.struct(F.lit(which).alias("_which"), F.col(b).alias("_of"), (F.col(k) - F.col(b) * F.lit(block).cast("long")).alias("_rest"))
    requests = pieces.filter(hit).select("_k", "_l", "_block", "_piece", F.inline(F.array(request(0, "_first", "_a"), request(1, "_last", "_b")))).filter("_of = _block")
    units = requests.select("_k", "_l", "_block", "_which", "_rest", F.posexplode(F.regexp_extract_all("_piece", F.lit(UNITS[unit]), F.lit(0))).alias("_at", "_unit"))
    inside = F.sum(F.when(F.col("_at") < F.col("_rest"), F.length("_unit")).otherwise(0)).alias("_units")
    cuts = units.groupBy("_k", "_l", "_block", "_which").agg(inside, F.count_if(F.col("_at") == 0).alias("_copies"))
    ends = cuts.join(starts, ["_k", "_l", "_block"]).select("_k", "_l", "_which", (F.col("_start") + F.expr("_units div _copies")).alias("_end"))
    one = lambda which: F.max(F.when(F.col("_which") == which, F.col("_end")))
    return ends.groupBy("_k", "_l").agg(one(0).alias("_from"), one(1).alias("_to"))


def restored(output: Column, form: Column) -> Column:
    """The text again from an output; marks cannot occur in a text that was cut, so the first of each kind is ours."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    last = lambda a: F.substring_index(output, a, -1)
    psm = F.concat(between(P, S), last(M), between(S, M))
    spm = F.concat(between(P, M), last(M), between(S, P))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infilled(docs: DataFrame, ident: str = "doc_id", unit: str = "code_point", cut: int = CUT, spm: int = SPM, block: int = BLOCK) -> DataFrame:
    """``ident``, n (units), form, prefix_chars, middle_chars, output and restored for every row of ``docs``.

    A null text is empty; empty texts, texts that hold a mark and those not drawn stay plain, with null lengths.  Equal
    rows have equal results, each its own row; rows of one id with different texts are cut each by itself.  An empty
    table gives an empty result.  Other columns of ``docs`` are not read, whatever their names.
    """
    rows = planned(docs, ident, unit, cut, spm)
    at = offsets(rows.filter("_form <> 'plain'"), unit, block)
    # the side that is hashed has one small row for each document
    both = rows.join(at.hint("shuffle_hash"), ["_k", "_l"], "left")
    part = lambda a, b: F.substr(F.col("_text"), (a + 1).cast("int"), (b - a).cast("int"))
    prefix, middle, suffix = part(F.lit(0), F.col("_from")), part(F.col("_from"), F.col("_to")), part(F.col("_to"), F.length("_text"))
    output = F.when(F.col("_form") == "psm", F.concat(F.lit(P), prefix, F.lit(S), suffix, F.lit(M), middle)).when(F.col("_form") == "spm", F.concat(F.lit(S), suffix, F.lit(P), prefix, F.lit(M), middle)).otherwise(F.col("_text"))
    out = both.select(F.col("_id").alias(ident), F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_from").cast("long").alias("prefix_chars"), (F.col("_to") - F.col("_from")).cast("long").alias("middle_chars"), output.alias("output"))
    return out.withColumn("restored", restored(F.col("output"), F.col("form")))


def infill_digest(docs: DataFrame) -> DataFrame:
    out = infilled(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
