"""The assembly pipeline: reads to counted (k+1)-mers, graph, contigs, simplified graph, sequences."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import compact, contigs, dbg, kmers, paths, simplify
from helixframe.sources.config import PATHS, Parameters
from helixframe.sources.fastq import named, write_fasta
from helixframe.storage import drop, stage


class Assembly:
    """Each step as a table, computed once when first needed; write() keeps them, and load() goes on from kept ones.

    ranks and components are two ways to the same groups; contigs are built from ranks, which have the order too. Where vertices have
    an odd number of up to 31 bases, all three start from pieces of paths that buckets of vertices have joined, else from single vertices.
    bases: about how many the reads have, if it is known.
    """

    TABLES = ("kplus", "vertices", "ranks", "contigs", "filtered", "graph", "groups")

    def __init__(self, reads: DataFrame, parameters: Parameters = Parameters(), seq: str = "seq", wrap256: bool = False, emit_isolated: bool = False, bases: int | None = None):
        self.reads, self.p, self.seq, self.wrap256, self.emit_isolated, self.bases = reads, parameters, seq, wrap256, emit_isolated, bases
        self.by_buckets = compact.fits(self.k)

    @property
    def k(self) -> int:
        return self.p.k_mer_t

    @cached_property
    def kplus(self) -> DataFrame:
        return stage(kmers.count_kplus(self.reads, self.k, self.p.freq_t, self.wrap256, self.seq), "kplus")

    @cached_property
    def edges(self) -> DataFrame:
        return dbg.edges(self.kplus, self.k)

    @cached_property
    def vertices(self) -> DataFrame:
        return stage(dbg.vertices(self.edges), "vertices")

    @cached_property
    def typed(self) -> DataFrame:
        return stage(dbg.typed(self.edges, self.vertices), "typed")

    @cached_property
    def pieces(self) -> DataFrame:
        return stage(compact.pieces(self.reads, self.k, self.p.freq_t, self.wrap256, self.seq, self.bases), "pieces", "is_piece")

    @cached_property
    def piece_nodes(self) -> DataFrame:
        return stage(compact.nodes(self.pieces), "piece_nodes")

    @cached_property
    def placed(self) -> tuple[DataFrame, DataFrame | None]:
        """The pieces of open paths in their order, and the ranked vertices of circles, which go vertex by vertex."""
        ends, circular = paths.jump(self.piece_nodes)
        made = stage(compact.placed(self.pieces, ends), "placed")
        circles = None if circular.isEmpty() else stage(paths.list_rank(*self._circles(circular)), "circles")
        drop(ends, circular)
        return made, circles

    def _circles(self, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(typed edges, vertices) of the circles that pieces with these heads make; a circle's vertices are all unambiguous."""
        members = stage(compact.vertices(self.pieces, heads, self.k).withColumn("vtype", F.lit(dbg.UNAMBIGUOUS)), "circle_vertices")
        own = self.edges.join(members.select(F.col("v").alias("src")), "src", "left_semi")
        self.circle_edges = stage(own.withColumns({"src_type": F.lit(dbg.UNAMBIGUOUS), "dst_type": F.lit(dbg.UNAMBIGUOUS)}), "circle_edges")
        return self.circle_edges, members

    @cached_property
    def ranks(self) -> DataFrame:
        if not self.by_buckets:
            return stage(paths.list_rank(self.typed, self.vertices), "ranks")
        open_, circles = self.placed
        rows = compact.ranks(open_, self.k)
        return stage(rows.unionByName(circles) if circles else rows, "ranks")

    @cached_property
    def components(self) -> DataFrame:
        if not self.by_buckets:
            return paths.path_components(self.typed, self.vertices)
        return compact.components(self.pieces, self.piece_nodes, self.k)

    @cached_property
    def contigs(self) -> DataFrame:
        if not self.by_buckets:
            return stage(contigs.merge(self.ranks, self.typed), "contigs")
        open_, circles = self.placed
        made = compact.contigs(open_, self.k)
        return stage(made.unionByName(contigs.merge(circles, self.circle_edges)) if circles else made, "contigs")

    @cached_property
    def filtered(self) -> DataFrame:
        return stage(contigs.bubble_filter(self.contigs, self.p.bubble_t), "filtered")

    @cached_property
    def graph(self) -> DataFrame:
        return stage(simplify.contig_graph(self.ambiguous, self.filtered, self.k, self.p.tip_t), "contig_graph")

    @cached_property
    def pruned(self) -> tuple[DataFrame, DataFrame]:
        return simplify.remove_tips(self.graph, self.k, self.p.tip_t)

    @cached_property
    def groups(self) -> DataFrame:
        return stage(simplify.groups(*self.pruned), "groups")

    @cached_property
    def sequences(self) -> DataFrame:
        return simplify.merge(self.filtered, *self.pruned, self.groups, self.k, self.p.output_contig_t, self.emit_isolated)

    @property
    def ambiguous(self) -> DataFrame:
        return compact.bare_edges(self.pieces, self.k) if self.by_buckets else dbg.ambiguous_edges(self.typed)

    @property
    def pruned_graph(self) -> DataFrame:
        return self.pruned[0]

    @property
    def pruned_states(self) -> DataFrame:
        return self.pruned[1]

    def write(self, path: str) -> None:
        """The tables as Parquet folders of these names, with the graph and vertices left after tips, replacing older ones."""
        for name in (*self.TABLES, "pruned_graph", "pruned_states"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def write_each(self, paths: dict[str, str]) -> None:
        """Keep the tables of each key of config.PATHS in its folder, and the sequences as FASTA in theirs, replacing older ones."""
        for key, names in PATHS.items():
            if key not in paths or names == ("reads",):
                continue
            if names == ("sequences",):
                write_fasta(named(self.sequences), paths[key])
                continue
            for name in names:
                getattr(self, name).write.mode("overwrite").parquet(f"{paths[key]}/{name}")

    def load(self, path: str) -> Assembly:
        """Take the tables from where write() has put them; reads are not needed then."""
        spark, self.by_buckets = self.reads.sparkSession, False  # from the kept tables, not from reads
        for name in self.TABLES:
            self.__dict__[name] = spark.read.parquet(f"{path}/{name}")
        self.__dict__["pruned"] = tuple(spark.read.parquet(f"{path}/{name}") for name in ("pruned_graph", "pruned_states"))
        return self
