"""Unambiguous paths of an oriented graph by pointer jumping, and what is stitched from them.

A node (v, h) has at most one successor inside the paths, and each path exists on both strands. In each round a node takes over
its pointer's pointer, so a path of n nodes takes about log2 n rounds; only nodes that have not reached their end take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators.components import connected_components
from helixframe.storage import drop, drop_part, stage


def jump(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ends, circular) from (v, h, nv, nh, w): successor nv, nh, or null, and the weight of that step.

    A node that stands for a run of w vertices has columns lv, lh too, the run's last; the path's last vertex is then the end.

    ends: (v, h, ev, eh, dist), the last node from each and the weight to it. circular: (v, h), the nodes that have no end. Both are
    staged; the rounds' tables are deleted, the active nodes of a round as soon as the next is written.
    """
    last_v, last_h, rest = ("lv", "lh", F.col("w") - 1) if "lv" in nodes.columns else ("v", "h", F.lit(0))
    start = nodes.select("v", "h", F.coalesce("nv", last_v).alias("pv"), F.coalesce("nh", last_h).alias("ph"), F.when(F.col("nv").isNull(), rest).otherwise(F.col("w")).cast("long").alias("dist"), F.col("nv").isNull().alias("done"))
    tables = [stage(start, "jump", "done")]
    finished = [tables[0].filter("done")]
    active = tables[0].filter("not done")
    while True:
        state = reduce(DataFrame.union, [*finished, active])
        target = state.select(F.col("v").alias("pv"), F.col("h").alias("ph"), F.col("pv").alias("qv"), F.col("ph").alias("qh"), F.col("dist").alias("more"), F.col("done").alias("reached"))
        moved = active.drop("done").join(target, ["pv", "ph"])
        moved = stage(moved.select("v", "h", F.col("qv").alias("pv"), F.col("qh").alias("ph"), (F.col("dist") + F.col("more")).alias("dist"), F.col("reached").alias("done")), "jump", "done")
        if moved.filter("done").isEmpty():  # each round some node of every open path ends, so only circles are left
            ends = stage(reduce(DataFrame.union, finished).select("v", "h", F.col("pv").alias("ev"), F.col("ph").alias("eh"), "dist"), "ends")
            circular = stage(active.select("v", "h"), "circular")
            drop(moved, *tables)
            return ends, circular
        drop_part(tables[-1], "done", "false")
        tables.append(moved)
        finished.append(moved.filter("done"))
        active = moved.filter("not done")


def cut_circles(nodes: DataFrame, circular: DataFrame, slots: DataFrame) -> DataFrame:
    """The nodes of circles with the way into the smallest vertex cut, as it leaves by its first slot; slots: (v, h, slot)."""
    own = stage(nodes.join(circular, ["v", "h"], "left_semi"), "circles")
    found = connected_components(own, "v", "nv").filter("node = root")
    first = slots.join(found.select(F.col("root").alias("v")), "v").groupBy("v").agg(F.min_by("h", "slot").alias("head_h"))
    into = first.select(F.col("v").alias("nv"), F.col("head_h").alias("nh"), F.lit(True).alias("cut"))
    back = first.select("v", (~F.col("head_h")).alias("h"), F.lit(True).alias("cut_back"))
    marked = own.join(into, ["nv", "nh"], "left").join(back, ["v", "h"], "left")
    gone = F.coalesce("cut", "cut_back").isNotNull()
    return marked.select("v", "h", F.when(~gone, F.col("nv")).alias("nv"), F.when(~gone, F.col("nh")).alias("nh"), "w")


def ranked(nodes: DataFrame, slots: DataFrame) -> DataFrame:
    """(v, h, group_id, rnk, last, is_cycle): every node of a path on the strand that starts at the smaller of its end vertices.

    rnk counts from 0 in steps, last marks its last node. A path of one vertex is read so that it is left by its last slot.
    """
    steps = nodes.withColumn("w", F.lit(1))
    ends, circular = jump(steps)
    rows = ends.withColumn("is_cycle", F.lit(False))
    if not circular.isEmpty():
        cut = stage(cut_circles(steps, circular, slots), "cut")
        more, none = jump(cut)
        drop(cut, none)
        rows = rows.union(more.withColumn("is_cycle", F.lit(True)))
    drop(circular)
    twin = rows.select("v", (~F.col("h")).alias("h"), F.col("ev").alias("first_v"), F.col("dist").alias("rnk"))
    both = rows.join(twin, ["v", "h"])
    single = (F.col("dist") == 0) & (F.col("rnk") == 0)
    last_slot = slots.groupBy("v").agg(F.max_by("h", F.struct("slot", "h")).alias("way"))
    kept = both.filter((F.col("first_v") < F.col("ev")) | (F.col("first_v") == F.col("ev"))).join(last_slot, "v", "left")
    kept = kept.filter(F.when(single, F.col("h") == F.coalesce("way", F.lit(False))).otherwise((F.col("first_v") < F.col("ev")) | ~F.col("h")))
    return kept.select("v", "h", F.col("first_v").alias("group_id"), "rnk", (F.col("dist") == 0).alias("last"), "is_cycle")


def inner_nodes(typed_edges: DataFrame, members: DataFrame) -> DataFrame:
    """(v, h, nv, nh) for both strands of each of members (v); the successor is null if the edge leaves the members or is missing."""
    nodes = members.select("v", F.explode(F.array(F.lit(False), F.lit(True))).alias("h"))
    inside = typed_edges.filter("src_type <> 3 and dst_type <> 3").select(F.col("src").alias("v"), F.col("src_h").alias("h"), F.col("dst").alias("nv"), F.col("dst_h").alias("nh"))
    return nodes.join(inside, ["v", "h"], "left")


def slots_of(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select(F.col("src").alias("v"), F.col("src_h").alias("h"), "slot")


def _packs(members: DataFrame) -> int | None:
    """The length that all vertices share if they are bases and fit a long, else null."""
    least, most, bases = members.agg(F.min(F.length("v")), F.max(F.length("v")), F.bool_and(F.col("v").rlike("^[ACGT]+$"))).first()
    return most if bases and least == most and most <= 31 else None


def list_rank(typed_edges: DataFrame, vertex_rows: DataFrame) -> DataFrame:
    """Groups of unambiguous vertices, by pointer jumping: the id is the smaller end, in a circle the smallest vertex.

    Vertices of up to 31 bases go through the rounds as numbers, in the same order: a third of the bytes, and no comparison of letters.
    """
    members = vertex_rows.filter("vtype <> 3").select("v")
    nodes, slots, k = inner_nodes(typed_edges, members), slots_of(typed_edges.filter("src_type <> 3")), _packs(members)
    if k:
        nodes, slots = nodes.withColumns({"v": S.pack("v"), "nv": S.pack("nv")}), slots.withColumn("v", S.pack("v"))
    nodes = stage(nodes, "nodes")
    out = ranked(nodes, slots)
    if k:
        out = out.withColumns({"v": S.unpack("v", k), "group_id": S.unpack("group_id", k)})
    drop(nodes)
    return out


def path_components(typed_edges: DataFrame, vertex_rows: DataFrame) -> DataFrame:
    """(v, group_id): the same groups as connected components, named by their smallest vertex."""
    inside = typed_edges.filter("src_type <> 3 and dst_type <> 3")
    found = connected_components(inside.select("src", "dst"), "src", "dst")
    members = vertex_rows.filter("vtype <> 3").select("v")
    return members.join(found.withColumnRenamed("node", "v"), "v", "left").select("v", F.coalesce("root", "v").alias("group_id"))
