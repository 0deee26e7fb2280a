"""The bidirected de Bruijn graph as a table of oriented edges.

A vertex is a canonical k-mer; (v, h) reads it on one strand, h true for the reverse complement. Each (k+1)-mer gives an edge
and its twin on the other strand, kept both even where they coincide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequence as S

DEAD_END, UNAMBIGUOUS, AMBIGUOUS = 1, 2, 3


def slot(is_in: Column, left_h: Column, right_h: Column, base: Column) -> Column:
    """Place of an edge among a vertex' slots: LL, LH, HL, HH; in each in before out, and A, T, G, C."""
    return (F.when(left_h, 16).otherwise(0) + F.when(right_h, 8).otherwise(0) + F.when(is_in, 0).otherwise(4) + F.instr(F.lit("ATGC"), base) - 1).cast("int")


def edges(kplus: DataFrame, k: int) -> DataFrame:
    """(src, src_h, dst, dst_h, base, cnt, slot): base is appended to the source's letters; slot is the edge's place at the source."""
    left, right = F.substring("kp1", 1, k), F.substring("kp1", 2, k)
    both = kplus.select(
        "kp1", "cnt", S.canonical(left).alias("l"), S.is_high(left).alias("lh"), S.canonical(right).alias("r"), S.is_high(right).alias("rh"), F.substring("kp1", 1, 1).alias("first"), F.substring("kp1", -1, 1).alias("last")
    )
    edge = F.struct(F.col("l").alias("src"), F.col("lh").alias("src_h"), F.col("r").alias("dst"), F.col("rh").alias("dst_h"), F.col("last").alias("base"), F.col("cnt"), slot(F.lit(False), F.col("lh"), F.col("rh"), F.col("last")).alias("slot"))
    twin = F.struct(F.col("r").alias("src"), (~F.col("rh")).alias("src_h"), F.col("l").alias("dst"), (~F.col("lh")).alias("dst_h"), S.complement("first").alias("base"), F.col("cnt"), slot(F.lit(True), F.col("lh"), F.col("rh"), F.col("first")).alias("slot"))
    return both.select(F.inline(F.array(edge, twin)))


def vertex_type(d_l: Column, d_h: Column) -> Column:
    return F.when(d_l + d_h == 1, DEAD_END).when((d_l == 1) & (d_h == 1), UNAMBIGUOUS).otherwise(AMBIGUOUS)


def vertices(edge_rows: DataFrame) -> DataFrame:
    """(v, d_l, d_h, vtype) of the sources of oriented edges."""
    side = F.col("src_h")
    degrees = edge_rows.groupBy(F.col("src").alias("v")).agg(F.count_if(~side).cast("int").alias("d_l"), F.count_if(side).cast("int").alias("d_h"))
    return degrees.withColumn("vtype", vertex_type(F.col("d_l"), F.col("d_h")))


def bitmaps(edge_rows: DataFrame) -> DataFrame:
    """(v, bitmap, counts): slots that have an edge as bits from the lowest slot up, and the counts in slot order."""
    per_slot = edge_rows.groupBy(F.col("src").alias("v"), "slot").agg(F.sum("cnt").alias("cnt"))
    own = F.sort_array(F.collect_list(F.struct("slot", "cnt")))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot")))
    return per_slot.groupBy("v").agg(bits.alias("bitmap"), F.transform(own, lambda x: x["cnt"]).alias("counts"))


def typed(edge_rows: DataFrame, vertex_rows: DataFrame) -> DataFrame:
    """Edges with src_type and dst_type; dst may be null, and then has none."""
    own = vertex_rows.select(F.col("v").alias("src"), F.col("vtype").alias("src_type"))
    other = vertex_rows.select(F.col("v").alias("dst"), F.col("vtype").alias("dst_type"))
    return edge_rows.join(own, "src").join(other, "dst", "left")


def ambiguous_edges(typed_edges: DataFrame) -> DataFrame:
    """Edges with an ambiguous vertex at both ends."""
    return typed_edges.filter((F.col("src_type") == AMBIGUOUS) & (F.col("dst_type") == AMBIGUOUS))
