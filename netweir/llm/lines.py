"""Line dedup: lines found in many documents go, everywhere.

Normalised lines are hashed and exploded, documents are counted for each hash, and what is over the threshold is
joined back to the places of lines; a document is put together again from the places that stay.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: A key of at least CHARS code points in at least DOCUMENTS documents goes.
CHARS, DOCUMENTS = 1, 10
BLANK = " \t\n\x0b\x0c\r"


def normalised(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    bare = F.trim(line, F.lit(BLANK))
    # a line of ASCII alone has one way to be lower-cased, and that is fast
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes_of(lines: Column, chars: int) -> Column:
    """The 128-bit hash of each line's key, null for keys that are too short."""
    hashed = lambda k: F.when(F.length(k) >= chars, F.struct(F.xxhash64(F.lit(1), k).alias("h"), F.xxhash64(F.lit(2), k).alias("g")))
    return F.transform(F.transform(lines, normalised), hashed)


def frequent_lines(hashed: DataFrame, documents: int) -> DataFrame:
    """h, g, documents: hashes in at least so many rows of ``hashed``; counts are summed before they are shuffled."""
    each = hashed.select(F.explode(F.array_distinct("_hashes")).alias("x")).filter("x IS NOT NULL").select("x.h", "x.g")
    return each.groupBy("h", "g").agg(F.count("*").alias("documents")).filter(F.col("documents") >= documents)


def without_frequent_lines(docs: DataFrame, ident: str = "doc_id", documents: int = DOCUMENTS, chars: int = CHARS) -> DataFrame:
    """``ident``, n_lines, n_dropped and kept for every row of ``docs``.

    A row is a document: equal rows count each.  A null or empty text is one empty line, which has no key and stays.
    Texts of any length are whole.  If all lines go, kept is empty.  An empty table gives an empty result.  Other
    columns of ``docs`` are not read, whatever their names.
    """
    base = docs.select(F.col(ident).alias("_id"), F.col("text").alias("_text"), F.xxhash64(F.lit(1), ident, "text").alias("_k"), F.xxhash64(F.lit(2), ident, "text").alias("_l"))
    # 16 bytes for a line: texts are normalised once
    hashed = durable(base.select("_k", "_l", hashes_of(lines_of(F.col("_text")), chars).alias("_hashes")))
    # a table of its own, so that the join below is between two shuffles and a hot line can be split
    frequent = durable(frequent_lines(hashed, documents))
    places = hashed.select("_k", "_l", F.posexplode("_hashes").alias("_at", "_x")).filter("_x IS NOT NULL").select("_k", "_l", "_at", F.col("_x.h").alias("h"), F.col("_x.g").alias("g"))
    gone = places.join(frequent.select("h", "g"), ["h", "g"]).groupBy("_k", "_l").agg(F.collect_set("_at").alias("_gone"))
    both = base.join(gone.hint("shuffle_hash"), ["_k", "_l"], "left").select("_id", lines_of(F.col("_text")).alias("_lines"), F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    # a lambda names the lines, so that they are cut once and not for every place
    kept = F.flatten(F.transform(F.array(F.col("_lines")), lambda xs: F.transform(stay, lambda i: F.get(xs, i))))
    return both.select(F.col("_id").alias(ident), F.size("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))


def lines_digest(docs: DataFrame) -> DataFrame:
    return without_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
