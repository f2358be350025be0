"""Filters that let through few rows besides those wanted, as bitmaps built and read by DataFrame functions.

A filter over many items is a table of bitmap pages. It is built by one aggregation, its size is set beforehand, and it is
small enough to be sent to every executor; rows that cannot be among the items are then dropped where they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duowave.plans.scratch import materialize

# Bits of one page (fixed by Spark's bitmap functions), bits per item, and the most bits of a filter (32 MB).
PAGE_BITS = 32_768
ITEM_BITS = 16
MOST_BITS = 1 << 28


def filter_bits(items: int, most_bits: int = MOST_BITS) -> int:
    """Number of bits for a filter: a power of two, so many items let through a sixteenth of the others or less."""
    return min(most_bits, max(PAGE_BITS, 1 << (max(1, items) * ITEM_BITS - 1).bit_length()))


def _place(columns: Sequence[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def bitmap_pages(items: DataFrame, columns: Sequence[str], bits: int) -> DataFrame:
    """Written pages ``page`` and ``bitmap`` of a filter over the values of ``columns``; at most ``bits / PAGE_BITS`` rows."""
    place = _place([F.col(c) for c in columns], bits)
    pages = items.select(place.alias("place")).groupBy(F.expr(f"place div {PAGE_BITS}").alias("page")).agg(
        F.bitmap_construct_agg(F.col("place") % PAGE_BITS).alias("bitmap"))
    return materialize(pages, "bitmaps")


def maybe_among(df: DataFrame, columns: Sequence[Column], pages: DataFrame, bits: int) -> DataFrame:
    """Rows of ``df`` whose values may be among the filter's items, without a shuffle; nulls are values like others.

    No item's row is lost. Columns must have the types that the filter was built from.
    """
    # Names that no column of the rows has.
    mark = "_" * (1 + max(map(len, df.columns)))
    place, page, bitmap = (f"{mark}{n}" for n in ("place", "page", "bitmap"))
    pages = pages.select(F.col("page").alias(page), F.col("bitmap").alias(bitmap))
    placed = df.withColumn(place, _place(columns, bits))
    hit = placed.join(F.broadcast(pages), F.expr(f"{place} div {PAGE_BITS}") == F.col(page))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.expr(f"({place} % {PAGE_BITS}) div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr(f"shiftleft(1, CAST({place} % 8 AS INT))")
    return hit.where(byte.bitwiseAND(bit) != 0).select(*df.columns)
