"""The graph of ambiguous vertices and contigs: building it, removing tips, and merging what is then unambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import dbg, paths
from helixframe.storage import drop, stage


def tip_contigs(contigs: DataFrame, k: int, tip_t: int) -> DataFrame:
    """Contigs of at most k - 1 + tip_t bases that lack a neighbour."""
    return contigs.filter((F.col("length") <= k - 1 + tip_t) & (F.col("in_nb").isNull() | F.col("out_nb").isNull()))


def contig_graph(ambiguous: DataFrame, contigs: DataFrame, k: int, tip_t: int) -> DataFrame:
    """(src, src_h, dst, dst_h, contig_id, rev, length, cnt, slot): edges between ambiguous vertices, bare or through a contig.

    Tips and contigs without neighbours give none; a contig with one neighbour leads from it to a null dst. rev: the contig is read
    backwards on the way from src. Slots order a vertex' edges: bare ones first.
    """
    bare = ambiguous.select("src", "src_h", "dst", "dst_h", F.lit(None).cast("string").alias("contig_id"), F.lit(False).alias("rev"), F.lit(0).alias("length"), "cnt", "slot")
    body = contigs.filter(~((F.col("length") <= k - 1 + tip_t) & (F.col("in_nb").isNull() | F.col("out_nb").isNull())))
    way = F.struct(F.col("in_nb").alias("src"), F.col("in_h").alias("src_h"), F.col("out_nb").alias("dst"), F.col("out_h").alias("dst_h"), "contig_id", F.lit(False).alias("rev"))
    back = F.struct(F.col("out_nb").alias("src"), (~F.col("out_h")).alias("src_h"), F.col("in_nb").alias("dst"), (~F.col("in_h")).alias("dst_h"), "contig_id", F.lit(True).alias("rev"))
    through = body.select(F.explode(F.array(way, back)).alias("e"), "length").select("e.*", "length", F.lit(None).cast("long").alias("cnt")).filter("src is not null")
    return bare.unionByName(through.withColumn("slot", F.when(F.col("rev"), 64).otherwise(68)))


def vertex_states(graph: DataFrame) -> DataFrame:
    """(v, d_l, d_h, vtype) of the vertices with an edge."""
    return dbg.vertices(graph.withColumn("cnt", F.coalesce("cnt", F.lit(0))))


def _probe(graph: DataFrame, states: DataFrame, most: int) -> DataFrame:
    """(v, verdict): what becomes of the vertices on paths from dead ends; states: (v, vtype, status)."""
    kind = states.select(F.col("v").alias("dst"), F.col("vtype").alias("dst_type"), F.col("status").alias("dst_status"))
    open_ = states.filter("status = 'normal' and vtype <> 3").select(F.col("v").alias("src"), F.col("vtype").alias("src_type"))
    rows = stage(graph.join(open_, "src").join(kind, "dst", "left"), "probe")
    on = (F.col("dst_type") == 2) & (F.col("dst_status") == "normal")
    succ = rows.select(F.col("src").alias("v"), F.col("src_h").alias("h"), "src_type", F.when(on, F.col("dst")).alias("nv"), F.when(on, F.col("dst_h")).alias("nh"), (F.col("length") + 1).alias("w"))
    ends, circular = paths.jump(succ.select("v", "h", "nv", "nh", "w"))
    final = rows.select(F.col("src").alias("ev"), F.col("src_h").alias("eh"), "dst", "dst_status", (F.col("length") + F.when(F.col("dst").isNull(), 0).otherwise(1)).alias("step"))
    heads = succ.filter("src_type = 1").select("v", "h").join(ends, ["v", "h"]).join(final, ["ev", "eh"])
    short = 1 + F.col("dist") + F.col("step") <= most
    verdict = F.when(F.coalesce("dst_status", F.lit("normal")) != "normal", F.col("dst_status")).when(short, "deleted").otherwise("finished")
    judged = heads.select(F.col("ev").alias("v"), F.col("eh").alias("h"), verdict.alias("verdict"))
    walks = ends.select(F.col("v").alias("member"), F.col("ev").alias("v"), F.col("eh").alias("h"))
    out = stage(walks.join(judged, ["v", "h"]).select(F.col("member").alias("v"), "verdict").distinct(), "verdicts")
    drop(rows, ends, circular)
    return out


def remove_tips(graph: DataFrame, k: int, tip_t: int) -> tuple[DataFrame, DataFrame]:
    """(graph, states) after rounds of probes from dead ends, until no open dead end is left.

    A path from a dead end to the next ambiguous vertex, end, or vertex already judged costs its vertices, with the last, plus the
    lengths of its contigs. Within k - 1 + tip_t it is deleted with its edges, beyond it is finished and stays.
    """
    now = stage(graph, "graph")
    all_ = stage(vertex_states(now).select("v", "vtype", F.lit("normal").alias("status")), "states")
    while not all_.filter("status = 'normal' and vtype = 1").isEmpty():
        verdicts = _probe(now, all_, k - 1 + tip_t)
        marked = stage(all_.join(verdicts, "v", "left").select("v", "vtype", F.coalesce("verdict", "status").alias("status")), "states")
        gone = marked.filter("status = 'deleted'").select("v")
        left = now.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti")
        pruned = stage(left.select(*graph.columns), "graph")
        drop(now, all_, verdicts)
        now = pruned
        again = vertex_states(now).select("v", F.col("vtype").alias("new"))
        kept = marked.filter("status <> 'deleted'").join(again, "v", "left")
        retyped = F.when(F.col("status") == "normal", F.coalesce("new", F.lit(dbg.AMBIGUOUS))).otherwise(F.col("vtype"))
        all_ = stage(kept.select("v", retyped.alias("vtype"), "status"), "states")
        drop(marked)
    return now, all_


def groups(graph: DataFrame, states: DataFrame) -> DataFrame:
    """Rank of the unambiguous vertices of the contig graph in their groups, as list_rank()."""
    return paths.list_rank(dbg.typed(graph, states), states)


def group_components(graph: DataFrame, states: DataFrame) -> DataFrame:
    """(v, group_id): the same groups as connected components."""
    return paths.path_components(dbg.typed(graph, states), states)


def merge(contigs: DataFrame, graph: DataFrame, states: DataFrame, ranks: DataFrame, k: int, min_len: int, emit_isolated: bool = False) -> DataFrame:
    """(kind, id, length, seq): a sequence a group, and the contigs at ambiguous vertices that no group used; longer than min_len.

    A group's pieces are its vertices and the contigs between and beside them, each in its strand, overlapping by k - 1 bases. Contigs
    at no vertex are lost, as in the model this follows; emit_isolated adds them. In a circle the closing contig comes once, at the end.
    """
    out = graph.select(F.col("src").alias("v"), F.col("src_h").alias("h"), "contig_id", "rev", "dst")
    own = ranks.select("group_id", (2 * F.col("rnk")).alias("pos"), S.oriented("v", "h").alias("seq"), F.lit(None).cast("string").alias("contig_id"))
    after = ranks.join(out, ["v", "h"]).filter("contig_id is not null").select("group_id", (2 * F.col("rnk") + 1).alias("pos"), "contig_id", "rev")
    first = ranks.filter("rnk = 0 and not is_cycle").select("v", (~F.col("h")).alias("h"), "group_id")
    before = first.join(out, ["v", "h"]).filter("contig_id is not null").select("group_id", F.lit(-1).cast("long").alias("pos"), "contig_id", (~F.col("rev")).alias("rev"))
    through = after.union(before).join(contigs.select("contig_id", "seq"), "contig_id")
    read = through.select("group_id", "pos", F.when(F.col("rev"), S.revcomp("seq")).otherwise(F.col("seq")).alias("seq"), "contig_id")
    pieces = stage(own.unionByName(read), "pieces")
    in_order = F.sort_array(F.collect_list(F.struct("pos", "seq")))
    joined = pieces.groupBy("group_id").agg(F.transform(in_order, lambda x: x["seq"]).alias("all"))
    whole = F.array_join(F.transform("all", lambda s, i: F.when(i == 0, s).otherwise(F.substr(s, F.lit(k)))), "")
    stitched = joined.select(F.lit("group").alias("kind"), F.col("group_id").alias("id"), whole.alias("seq"))
    rest = contigs.join(pieces.filter("contig_id is not null").select("contig_id").distinct(), "contig_id", "left_anti")
    vm = states.filter(F.col("vtype") == dbg.AMBIGUOUS).select(F.col("v").alias("src"))
    near = graph.filter("contig_id is not null").join(vm, "src", "left_semi").select("contig_id").distinct()
    alone = rest.join(near, "contig_id", "left_semi")
    if emit_isolated:
        alone = alone.union(rest.filter("in_nb is null and out_nb is null"))
    both = stitched.unionByName(alone.select(F.lit("contig").alias("kind"), F.col("contig_id").alias("id"), "seq"))
    return both.withColumn("length", F.length("seq")).filter(F.col("length") > min_len).select("kind", "id", "length", "seq")
