"""Contigs: the sequences of unambiguous paths, and bubbles among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequence as S

#: A pruned contig longer than this is kept all the same.
LONG = 10_000


def merge(ranks: DataFrame, typed_edges: DataFrame) -> DataFrame:
    """(contig_id, in_nb, in_h, in_cnt, out_nb, out_h, out_cnt, freq, length, seq) of the paths of list_rank().

    A contig's value grows with its path: its bases come together in one row, which is the result itself. freq is the least
    count between its vertices, null for one vertex. in_h and out_h are the strands of the neighbours as the contig is read.
    """
    out = typed_edges.filter("src_type <> 3").select(F.col("src").alias("v"), F.col("src_h").alias("h"), "dst", "dst_h", "cnt", "dst_type")
    back = out.select("v", (~F.col("h")).alias("h"), F.col("dst").alias("b_dst"), (~F.col("dst_h")).alias("b_h"), F.col("cnt").alias("b_cnt"), F.col("dst_type").alias("b_type"))
    rows = ranks.join(out, ["v", "h"], "left").join(back, ["v", "h"], "left")
    letters = S.oriented("v", "h")
    first = F.col("rnk") == 0
    entry, leave = first & (F.col("b_type") == 3), F.col("last") & (F.col("dst_type") == 3)
    tail = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rnk", F.substring(letters, -1, 1).alias("base")))), lambda x: x["base"]), "")
    made = rows.groupBy(F.col("group_id").alias("contig_id")).agg(
        F.max(F.when(entry, F.col("b_dst"))).alias("in_nb"),
        F.max(F.when(entry, F.col("b_h"))).alias("in_h"),
        F.max(F.when(entry, F.col("b_cnt"))).alias("in_cnt"),
        F.max(F.when(leave, F.col("dst"))).alias("out_nb"),
        F.max(F.when(leave, F.col("dst_h"))).alias("out_h"),
        F.max(F.when(leave, F.col("cnt"))).alias("out_cnt"),
        F.min(F.when(~F.col("last"), F.col("cnt"))).alias("freq"),
        F.max(F.when(first, letters)).alias("start"),
        tail.alias("bases"),
    )
    seq = F.concat("start", F.expr("substring(bases, 2)"))
    return made.withColumn("seq", seq).withColumn("length", F.length("seq")).select("contig_id", "in_nb", "in_h", "in_cnt", "out_nb", "out_h", "out_cnt", "freq", "length", "seq")


def bubble_pairs(contigs: DataFrame, bubble_t: int) -> DataFrame:
    """(nb1, nb2, a, b, a_freq, b_freq, near): contigs between the same two neighbours, a before b; near within that edit distance.

    An ambiguous vertex has eight neighbours at most, so a pair of them has few contigs.
    """
    both = contigs.filter("in_nb is not null and out_nb is not null").select(
        F.least("in_nb", "out_nb").alias("nb1"), F.greatest("in_nb", "out_nb").alias("nb2"), F.col("contig_id").alias("a"), F.coalesce("freq", F.lit(-1)).alias("a_freq"), (F.col("in_nb") < F.col("out_nb")).alias("a_mark"), F.col("seq").alias("a_seq")
    )
    other = both.withColumnsRenamed({"a": "b", "a_freq": "b_freq", "a_mark": "b_mark", "a_seq": "b_seq"})
    pairs = both.join(other, ["nb1", "nb2"]).filter("a < b")
    shown = F.when(F.col("a_mark") == F.col("b_mark"), F.col("a_seq")).otherwise(S.revcomp("a_seq"))
    near = S.edit_distance(shown, "b_seq", bubble_t) >= 0
    return pairs.select("nb1", "nb2", "a", "b", "a_freq", "b_freq", near.alias("near"))


def bubble_filter(contigs: DataFrame, bubble_t: int, long: int = LONG) -> DataFrame:
    """The contigs without the losers of bubbles. Contigs compare in ascending order of their ids."""
    pairs = bubble_pairs(contigs, bubble_t).filter("near").groupBy("nb1", "nb2").agg(F.sort_array(F.collect_list(F.struct("a", "b", "a_freq", "b_freq"))).alias("pairs"))

    def judge(gone: Column, pair: Column) -> Column:
        """The rarer of two near contigs goes, of equal ones the earlier; one that is gone is compared no more."""
        loser = F.when(pair["a_freq"] > pair["b_freq"], pair["b"]).otherwise(pair["a"])
        return F.when(F.array_contains(gone, pair["a"]), gone).otherwise(F.array_append(gone, loser))

    gone = pairs.select(F.explode(F.aggregate("pairs", F.array().cast("array<string>"), judge)).alias("contig_id"))
    losers = contigs.filter(F.col("length") <= long).select("contig_id").join(gone.distinct(), "contig_id", "left_semi")
    return contigs.join(losers, "contig_id", "left_anti")
