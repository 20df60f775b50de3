"""Repeated lines by range-partitioned hashes, in DataFrame operations only.

Every line that is long enough becomes a row (hash of its key, document, position); the rows are dealt by ranges of the
hash and sorted by hash, document and position, so that the first row of a key names the document that holds it.  The
other documents' lines are streamed past it and end up, set by set of 64 lines, in one bitmap per document.  Texts are
not moved until a caller applies the bitmaps.

Keys with more than one part in ``HOT`` of all lines (fewer than ``HOT`` keys, whatever the corpus) and more than
``LEAST_HOT`` lines would overload one range.  They are counted with partial sums, and their lines meet the first
document's id where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written
from .exact_dedup import ascii_lower

HOT, LEAST_HOT = 4096, 1024
SPACE = " \t\n\x0b\x0c\r"
KEY = ["_h", "_g", "_len"]


def text_check(text_col: str = "text") -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(F.lit("text"), text_of(text_col))


def line_keys(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``_h, _g, _len, _id, _check, _pos`` of every line whose key has at least ``least`` code points.

    Two 64-bit hashes of unlike seeds and the length stand for the key.
    """
    lines = df.select(F.col(id_col).alias("_id"), text_check(text_col).alias("_check"),
                      F.posexplode(F.split(ascii_lower(text_of(text_col)), "\n", -1)).alias("_pos", "_line"))
    keys = lines.select("_id", "_check", "_pos", F.btrim("_line", F.lit(SPACE)).alias("_key"))
    return keys.filter(F.char_length("_key") >= least).select(
        F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit("line"), "_key").alias("_g"), F.octet_length("_key").alias("_len"),
        "_id", "_check", "_pos")


def hot_keys(lines: DataFrame, bar: int) -> DataFrame:
    """``_h, _g, _len, _first``: keys of more than ``bar`` lines and the smallest id that holds each.

    Lines are first counted by 16 bits of the hash; only keys of the crowded parts are counted one by one.
    """
    part = F.shiftrightunsigned("_h", 48)
    crowded = lines.groupBy(part.alias("_part")).count().filter(F.col("count") > bar).select("_part")
    some = lines.withColumn("_part", part).join(F.broadcast(crowded), "_part", "left_semi")
    return some.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")).filter(F.col("_n") > bar).drop("_n")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, hot: int = HOT,
                   least_hot: int = LEAST_HOT) -> DataFrame:
    """``id_col, check, keep``: the keep bitmap of every document that loses a line; all others keep every line.

    A line's key is the line without white space (SPACE) at both ends, A-Z in lower case.  A key of at least ``least``
    code points stays only in the smallest id that holds it, there as often as it occurs.  ``keep`` lists (word, bits)
    for each run of 64 lines that loses one: bit b of word w says whether line 64 w + b stays; words that are not
    listed stay whole.

    A null text counts as empty, that is one empty line.  Null ids count as one document that comes after all others.
    Rows that share an id are one document: none takes a line from another; ``check`` (``text_check``) tells their texts
    apart, and equal rows share one bitmap.  Of equal keys in one document none is dropped for the other.  An empty
    table gives no rows.  Other columns are not read, so their names cannot clash.
    """
    lines = written(line_keys(df, id_col, text_col, least), "line-keys")
    bar = max(least_hot, lines.count() // hot)
    hot_first = written(hot_keys(lines, bar), "line-hot-keys")  # fewer than ``hot`` rows: each stands for more than 1/hot of the lines

    ranges = lines.join(F.broadcast(hot_first), KEY, "left_anti").repartitionByRange(*KEY)
    in_order = Window.partitionBy(*KEY).orderBy(F.asc_nulls_last("_id"), "_pos")
    streamed = ranges.withColumn("_first", F.first("_id").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    met = lines.join(F.broadcast(hot_first), KEY)
    lost = [rows.filter(~F.col("_id").eqNullSafe(F.col("_first"))).select("_id", "_check", "_pos") for rows in (streamed, met)]

    word, bit = F.expr("CAST(_pos DIV 64 AS INT)").alias("word"), F.expr("shiftleft(1L, _pos % 64)")
    words = lost[0].unionByName(lost[1]).groupBy("_id", "_check", word).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    maps = words.groupBy("_id", "_check").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))
    return maps.select(F.col("_id").alias(id_col), F.col("_check").alias("check"), "keep")


def lost_lines(keep: Column) -> Column:
    """How many lines a bitmap drops."""
    return F.aggregate(keep, F.lit(0).cast("long"), lambda n, w: n + (64 - F.bit_count(w["bits"])).cast("long"))


def kept_lines(lines: str, keep: str) -> Column:
    """The elements of the array column ``lines`` that the bitmap column ``keep`` keeps (all, if it is null)."""
    # Words that are not listed are put back first, so that each line finds its word by position.
    flat = f"""flatten(transform({keep}, (w, i) -> concat(
                 array_repeat(-1L, w.word - if(i = 0, 0, get({keep}, i - 1).word + 1)), array(w.bits))))"""
    some = f"filter({lines}, (x, i) -> coalesce(getbit(get(_flat, CAST(i DIV 64 AS INT)), i % 64), 1) = 1)"
    # The array of words is bound to a name by transforming a one-element array, so it is made once a row.
    return F.expr(f"if({keep} IS NULL, {lines}, transform(array({flat}), _flat -> {some})[0])")


def apply_bitmaps(df: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _text, _keep`` of every row of ``df`` with its bitmap (null if it loses nothing); the text is moved once."""
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), text_check(text_col).alias("_check"))
    found = maps.select(F.col(id_col).alias("_with"), F.col("check").alias("_with_check"), F.col("keep").alias("_keep"))
    same = F.col("_id").eqNullSafe(F.col("_with")) & (F.col("_check") == F.col("_with_check"))
    return rows.join(found, same, "left").select("_id", "_text", "_keep")


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """``id_col, text, n_lines, n_dropped`` of every row: the text without its repeated lines, and the counts.

    Nulls, repeats and empty tables are handled as in ``repeated_lines``; each row of ``df`` gives one row.  A text that
    loses all lines becomes empty.
    """
    rows = apply_bitmaps(df, repeated_lines(df, id_col, text_col, least), id_col, text_col)
    rows = rows.withColumn("_lines", F.split("_text", "\n", -1))
    text = F.when(F.col("_keep").isNull(), F.col("_text")).otherwise(F.array_join(kept_lines("_lines", "_keep"), "\n"))
    return rows.select(F.col("_id").alias(id_col), text.alias("text"), F.size("_lines").cast("long").alias("n_lines"),
                       F.coalesce(lost_lines(F.col("_keep")), F.lit(0)).cast("long").alias("n_dropped"))
