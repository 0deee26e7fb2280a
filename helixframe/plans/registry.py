"""Registered assembly queries over reads derived from the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import contigs, dbg, kmers, pregel, simplify, sort
from helixframe.plans.assembly import Assembly
from helixframe.sources import fastq
from helixframe.sources.config import Parameters
from helixframe.storage import table

K = 21
PARAMETERS = Parameters(k_mer_t=K, freq_t=1, bubble_t=1, tip_t=K, output_contig_t=100)
#: Tips of the derived reads that outlast tip_t are longer; up to this length they are removed from the same contig graph by queries of their own.
LONG_TIP = 2000

#: A genome of 32-base blocks from MD5 sums with a repeat in each 40th, and a read of 70 bases a row, some with a wrong base, every
#: second on the other strand. Spark and DuckDB understand the same text.
_LETTERS = "translate({}, '0123456789abcdef', 'ACGTACGTACGTACGT')"
_BLOCK = "CASE WHEN (b + {0}) % 40 = 0 THEN md5('R') ELSE md5(concat('', b + {0})) END"
READS = f"""
reads_at AS (
    SELECT l_orderkey, l_linenumber, (l_orderkey * 131 + l_linenumber * 977 + l_partkey * 17) % (32 * (SELECT max(p_partkey) FROM part) - 70) AS pos
    FROM lineitem),
blocks AS (SELECT l_orderkey, l_linenumber, CAST(pos % 32 + 1 AS INT) AS start, CAST(floor(pos / 32.0) AS BIGINT) AS b FROM reads_at),
raw AS (
    SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 70 + 1 AS INT) AS p,
           substr({_LETTERS.format("concat(" + ", ".join(_BLOCK.format(i) for i in range(4)) + ")")}, start, 70) AS s
    FROM blocks),
wrong AS (
    SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey * 7 + l_linenumber) % 97 = 0
           THEN concat(substr(s, 1, p - 1), translate(substr(s, p, 1), 'ACGT', 'CGTA'), substr(s, p + 1)) ELSE s END AS s
    FROM raw),
reads AS (
    SELECT l_orderkey * 10 + l_linenumber AS read_id, CASE WHEN l_linenumber % 2 = 0 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS seq
    FROM wrong)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    if len(lineitem.inputFiles()) < spark.sparkContext.defaultParallelism:  # else one file would be one task, and each row becomes many
        lineitem = lineitem.repartition(spark.sparkContext.defaultParallelism)
    text = READS.replace("FROM lineitem", "FROM {lineitem}").replace("FROM part)", "FROM {part})")
    return spark.sql(f"WITH {text} SELECT * FROM reads", lineitem=lineitem, part=table(spark, sf_dir, "part"))


_MADE: dict[tuple[str, str], Assembly] = {}


def assembly(spark: SparkSession, sf_dir: str) -> Assembly:
    """One a session and input, so queries share the tables they build on."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        _MADE[key] = Assembly(reads(spark, sf_dir), PARAMETERS, bases=70 * table(spark, sf_dir, "lineitem").count())
    return _MADE[key]



def _stats(sequences: DataFrame) -> DataFrame:
    """count, total, longest and N50: the length at which sequences as long or longer hold half of all bases."""
    by = sequences.groupBy("length").agg(F.count("*").alias("n"))
    rows = [(r.length, r.n) for r in by.orderBy(F.desc("length")).collect()]  # a row a distinct length
    total, before, n50 = sum(a * n for a, n in rows), 0, 0
    for length, n in rows:
        before += length * n
        if 2 * before >= total:
            n50 = length
            break
    return sequences.sparkSession.createDataFrame([(sum(n for _, n in rows), total, rows[0][0] if rows else 0, n50)], "n_sequences long, total_bases long, longest int, n50 int")


def _strandless(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", S.canonical("seq"))


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the small customer graph for the vertex programs: customer -> customer of the next key in the nation."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("a"), (F.col("c_nationkey") + 1_000_000).cast("long").alias("b"))


def _min_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _bases(spark, sf_dir)
    both = e.union(e.select("b", "a")).toDF("src", "dst")
    start = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))

    def compute(df, step, _):
        if step == 1:
            return df
        less = F.col("m") < F.col("label")
        return df.withColumns({"label": F.least("label", "m"), "active": F.coalesce(less, F.lit(False))})

    def send(df, step):
        return df.filter("active").join(both, df["id"] == both["src"]).select("dst", F.col("label").alias("m"))

    return pregel.run(start, compute, send, {"m": F.min("m")}).select("id", "label")


def _aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all path pointers are settled, and how many messages go out: what a superstep's aggregator holds."""
    v = assembly(spark, sf_dir).vertices
    return v.agg(F.bool_and(F.col("vtype") == 2).alias("all_unambiguous"), F.count_if(F.col("vtype") == 3).alias("n_ambiguous"), F.sum(F.col("d_l") + F.col("d_h")).alias("n_messages"), F.bit_or("vtype").alias("kinds"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "reads_scan": reads,
    "n_split": lambda s, d: kmers.split_reads(reads(s, d).withColumn("seq", F.replace("seq", F.lit("GAT"), F.lit("N")))).groupBy("seq").agg(F.count("*").alias("n")),
    "kmer_windows": lambda s, d: kmers.kplus_windows(reads(s, d), K).groupBy(F.substring("s", 1, 6).alias("prefix")).agg(F.count("*").alias("n")),
    "revcomp": lambda s, d: reads(s, d).select("read_id", S.revcomp("seq").alias("rc")),
    "canonical_kplus": lambda s, d: kmers.canonical_kplus(reads(s, d), K).groupBy(F.substring("kp1", 1, 5).alias("prefix")).agg(F.count("*").alias("n"), F.min("kp1").alias("least")),
    "homopolymer_filter": lambda s, d: kmers.canonical_kplus(reads(s, d), 2).groupBy("kp1").agg(F.count("*").alias("n")),
    "kmer_count": lambda s, d: kmers.count_kplus(reads(s, d), K),
    "kmer_freq_filter": lambda s, d: kmers.count_kplus(reads(s, d), K, 3),
    "kmer_count_mod256": lambda s, d: kmers.count_kplus(reads(s, d), 4, 1, True),
    "kmer_count_even": lambda s, d: kmers.count_kplus(reads(s, d), 12, 2),
    "dbg_edges": lambda s, d: assembly(s, d).edges,
    "dbg_vertices": lambda s, d: assembly(s, d).vertices.select("v", "d_l", "d_h"),
    "dbg_bitmap": lambda s, d: dbg.bitmaps(assembly(s, d).edges).select("v", "bitmap", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts")),
    "vertex_types": lambda s, d: assembly(s, d).vertices.groupBy("vtype").agg(F.count("*").alias("n")),
    "ambiguous_edges": lambda s, d: dbg.ambiguous_edges(assembly(s, d).typed).select("src", "src_h", "dst", "dst_h", "cnt"),
    "list_rank_groups": lambda s, d: assembly(s, d).ranks.select("v", "group_id"),
    "sv_components": lambda s, d: assembly(s, d).components,
    "contigs": lambda s, d: assembly(s, d).contigs,
    "contig_freq": lambda s, d: assembly(s, d).contigs.select("contig_id", "freq", "length"),
    "bubble_pairs": lambda s, d: contigs.bubble_pairs(assembly(s, d).contigs, PARAMETERS.bubble_t),
    "bubble_filter": lambda s, d: _strandless(assembly(s, d).filtered.select("contig_id", "length", "seq")),
    "tip_contigs": lambda s, d: simplify.tip_contigs(assembly(s, d).filtered, K, PARAMETERS.tip_t).select("contig_id", "length"),
    "contig_graph": lambda s, d: assembly(s, d).graph.select("src", "src_h", "dst", "dst_h", "contig_id", "length"),
    "tip_removal": lambda s, d: assembly(s, d).pruned[1],
    "tip_removal_edges": lambda s, d: assembly(s, d).pruned[0].select("src", "src_h", "dst", "dst_h", "contig_id", "length"),
    "tip_removal_long": lambda s, d: simplify.remove_tips(assembly(s, d).graph, K, LONG_TIP)[1],
    "tip_removal_long_edges": lambda s, d: simplify.remove_tips(assembly(s, d).graph, K, LONG_TIP)[0].select("src", "src_h", "dst", "dst_h", "contig_id", "length"),
    "ambi_groups": lambda s, d: assembly(s, d).groups.select("v", "group_id", "is_cycle"),
    "ambi_components": lambda s, d: simplify.group_components(*assembly(s, d).pruned),
    "assemble": lambda s, d: _strandless(assembly(s, d).sequences.select("length", "seq")),
    "assemble_fasta": lambda s, d: fastq.fasta(fastq.named(_strandless(assembly(s, d).sequences))),
    "assembly_stats": lambda s, d: _stats(assembly(s, d).sequences),
    "contig_stats": lambda s, d: _stats(assembly(s, d).filtered),
    "terasort_order": lambda s, d: sort.with_position(table(s, d, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber"), "l_extendedprice", "l_orderkey", "l_linenumber"),
    "pregel_min_label": _min_label,
    "message_combine": lambda s, d: pregel.combine(assembly(s, d).edges.select("dst", "cnt"), {"least": F.min("cnt"), "total": F.sum("cnt"), "n": F.count("*")}),
    "aggregator_and": _aggregates,
    "edit_distance": lambda s, d: table(s, d, "part").select("p_partkey", S.edit_distance("p_name", "p_type").alias("dist"), S.edit_distance("p_name", "p_type", 12).alias("bounded")),
    "union_inputs": lambda s, d: reads(s, d).select("seq").union(reads(s, d).select(S.revcomp("seq").alias("seq"))).groupBy(F.substring("seq", 1, 4).alias("prefix")).agg(F.count("*").alias("n")),
}

_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _canon(x: str) -> str:
    return f"least({x}, {_RC.format(x)})"


def _windows(k: int) -> str:
    return f"""{READS},
windows AS (SELECT substr(seq, i, {k + 1}) AS s FROM reads, range(1, {71 - k}) AS t(i)),
canon AS (SELECT {_canon("s")} AS kp1 FROM windows WHERE s <> repeat(substr(s, 1, 1), {k + 1}))"""


def _kplus(k: int) -> str:
    return f"""{_windows(k)},
kplus AS (SELECT kp1, count(*) AS cnt FROM canon GROUP BY kp1)"""


_GRAPH = f"""{_kplus(K)},
ends AS (SELECT kp1, cnt, substr(kp1, 1, {K}) AS l, substr(kp1, 2, {K}) AS r FROM kplus),
sides AS (
    SELECT cnt, {_canon("l")} AS a, {_RC.format("l")} <= l AS p, {_canon("r")} AS b, {_RC.format("r")} <= r AS q, substr(kp1, 1, 1) AS first, substr(kp1, -1, 1) AS last
    FROM ends),
edges AS (
    SELECT a AS src, p AS src_h, b AS dst, q AS dst_h, last AS base, cnt, CAST(16 * p::INT + 8 * q::INT + 3 + instr('ATGC', last) AS INT) AS slot FROM sides
    UNION ALL
    SELECT b, NOT q, a, NOT p, translate(first, 'ACGT', 'TGCA'), cnt, CAST(16 * p::INT + 8 * q::INT - 1 + instr('ATGC', first) AS INT) FROM sides),
vertices AS (
    SELECT src AS v, CAST(count(*) FILTER (NOT src_h) AS INT) AS d_l, CAST(count(*) FILTER (src_h) AS INT) AS d_h FROM edges GROUP BY src),
types AS (SELECT v, d_l, d_h, CASE WHEN d_l + d_h = 1 THEN 1 WHEN d_l = 1 AND d_h = 1 THEN 2 ELSE 3 END AS vtype FROM vertices),
typed AS (SELECT e.*, x.vtype AS src_type, y.vtype AS dst_type FROM edges e JOIN types x ON e.src = x.v JOIN types y ON e.dst = y.v)"""

#: Paths by walking from every node that nothing inside leads to; the derived reads have no circles.
_WALKS = f"""{_GRAPH},
succ AS (SELECT src AS v, src_h AS h, dst AS nv, dst_h AS nh, base, cnt FROM typed WHERE src_type <> 3 AND dst_type <> 3),
nodes AS (SELECT v, h FROM types, (VALUES (false), (true)) AS t(h) WHERE vtype <> 3),
heads AS (SELECT n.v, n.h FROM nodes n ANTI JOIN succ s ON s.v = n.v AND s.h = NOT n.h),
walk AS (
    SELECT v AS hv, h AS hh, v, h, CAST(0 AS BIGINT) AS rnk, CAST(NULL AS VARCHAR) AS base, CAST(NULL AS BIGINT) AS cnt FROM heads
    UNION ALL
    SELECT w.hv, w.hh, s.nv, s.nh, w.rnk + 1, s.base, s.cnt FROM walk w JOIN succ s ON s.v = w.v AND s.h = w.h),
tails AS (SELECT hv, hh, max(rnk) AS top, arg_max(v, rnk) AS tv, arg_max(h, rnk) AS th, string_agg(base, '' ORDER BY rnk) AS bases, min(cnt) AS freq FROM walk GROUP BY hv, hh),
way AS (SELECT src AS v, arg_max(src_h, slot) AS h FROM typed WHERE src_type <> 3 GROUP BY src),
kept AS (SELECT t.* FROM tails t LEFT JOIN way ON way.v = t.hv WHERE hv < tv OR (hv = tv AND hh = coalesce(way.h, false))),
contigs AS (
    SELECT hv AS contig_id, i.dst AS in_nb, NOT i.dst_h AS in_h, i.cnt AS in_cnt, o.dst AS out_nb, o.dst_h AS out_h, o.cnt AS out_cnt, freq,
           concat(CASE WHEN hh THEN {_RC.format("hv")} ELSE hv END, bases) AS seq
    FROM kept LEFT JOIN (SELECT * FROM typed WHERE dst_type = 3) i ON i.src = hv AND i.src_h = NOT hh
    LEFT JOIN (SELECT * FROM typed WHERE dst_type = 3) o ON o.src = tv AND o.src_h = th)"""

_BUBBLES = f"""{_WALKS},
linked AS (
    SELECT least(in_nb, out_nb) AS nb1, greatest(in_nb, out_nb) AS nb2, contig_id, coalesce(freq, -1) AS f, in_nb < out_nb AS mark, seq
    FROM contigs WHERE in_nb IS NOT NULL AND out_nb IS NOT NULL),
pairs AS (
    SELECT x.nb1, x.nb2, x.contig_id AS a, y.contig_id AS b, x.f AS a_freq, y.f AS b_freq,
           levenshtein(CASE WHEN x.mark = y.mark THEN x.seq ELSE {_RC.format("x.seq")} END, y.seq) <= {PARAMETERS.bubble_t} AS near
    FROM linked x JOIN linked y ON x.nb1 = y.nb1 AND x.nb2 = y.nb2 AND x.contig_id < y.contig_id)"""

_FILTERED = f"""{_BUBBLES},
numbered AS (SELECT *, row_number() OVER (PARTITION BY nb1, nb2 ORDER BY a, b) AS n FROM pairs),
fold AS (
    SELECT DISTINCT nb1, nb2, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS gone FROM pairs
    UNION ALL
    SELECT f.nb1, f.nb2, p.n, CASE WHEN NOT near OR list_contains(gone, a) THEN gone WHEN a_freq > b_freq THEN list_append(gone, b) ELSE list_append(gone, a) END
    FROM fold f JOIN numbered p ON p.nb1 = f.nb1 AND p.nb2 = f.nb2 AND p.n = f.n + 1),
losers AS (SELECT DISTINCT unnest(gone) AS contig_id FROM fold),
filtered AS (SELECT c.* FROM contigs c ANTI JOIN (SELECT contig_id FROM losers JOIN contigs USING (contig_id) WHERE length(seq) <= {contigs.LONG}) l USING (contig_id))"""

_CONTIG_GRAPH = f"""{_FILTERED},
body AS (SELECT * FROM filtered WHERE NOT (length(seq) <= {K - 1 + PARAMETERS.tip_t} AND (in_nb IS NULL OR out_nb IS NULL))),
contig_graph AS (
    SELECT src, src_h, dst, dst_h, CAST(NULL AS VARCHAR) AS contig_id, false AS rev, 0 AS length, slot FROM typed WHERE src_type = 3 AND dst_type = 3
    UNION ALL
    SELECT in_nb, in_h, out_nb, out_h, contig_id, false, CAST(length(seq) AS INT), 68 FROM body WHERE in_nb IS NOT NULL
    UNION ALL
    SELECT out_nb, NOT out_h, in_nb, NOT in_h, contig_id, true, CAST(length(seq) AS INT), 64 FROM body WHERE out_nb IS NOT NULL)"""

#: Rounds of tip removal written out in SQL. A round without an open dead end changes nothing; on sf0.01 one round removes something.
TIP_ROUNDS = 6

_KIND = "CASE WHEN count(*) = 1 THEN 1 WHEN count(*) = 2 AND count(*) FILTER (src_h) = 1 THEN 2 ELSE 3 END"


def _tip_round(i: int, tip_t: int) -> str:
    """graph{i} and states{i} from those of the round before: probes walk from open dead ends over open unambiguous vertices."""
    return f""",
probe{i} AS MATERIALIZED (
    SELECT g.src AS v, g.src_h AS h, o.vtype AS src_type, g.dst, d.status AS dst_status, g.length, coalesce(d.vtype = 2 AND d.status = 'normal', false) AS inner_dst, g.dst_h
    FROM graph{i - 1} g JOIN states{i - 1} o ON o.v = g.src AND o.status = 'normal' AND o.vtype <> 3 LEFT JOIN states{i - 1} d ON d.v = g.dst),
steps{i} AS (
    SELECT v AS hv, h AS hh, v, h, CAST(0 AS BIGINT) AS dist FROM probe{i} WHERE src_type = 1
    UNION ALL
    SELECT s.hv, s.hh, p.dst, p.dst_h, s.dist + p.length + 1 FROM steps{i} s JOIN probe{i} p ON p.v = s.v AND p.h = s.h WHERE p.inner_dst),
verdicts{i} AS MATERIALIZED (
    SELECT s.hv, s.hh, CASE WHEN coalesce(dst_status, 'normal') <> 'normal' THEN dst_status
                            WHEN 1 + s.dist + p.length + (p.dst IS NOT NULL)::INT <= {K - 1 + tip_t} THEN 'deleted' ELSE 'finished' END AS verdict
    FROM steps{i} s JOIN probe{i} p ON p.v = s.v AND p.h = s.h WHERE NOT p.inner_dst),
marked{i} AS MATERIALIZED (
    SELECT s.v, s.vtype, coalesce(j.verdict, s.status) AS status
    FROM states{i - 1} s LEFT JOIN (SELECT DISTINCT v, verdict FROM steps{i} JOIN verdicts{i} USING (hv, hh)) j ON j.v = s.v),
gone{i} AS MATERIALIZED (SELECT v FROM marked{i} WHERE status = 'deleted'),
graph{i} AS MATERIALIZED (SELECT * FROM graph{i - 1} WHERE src NOT IN (SELECT v FROM gone{i}) AND (dst IS NULL OR dst NOT IN (SELECT v FROM gone{i}))),
states{i} AS MATERIALIZED (
    SELECT m.v, CAST(CASE WHEN m.status = 'normal' THEN coalesce(n.vtype, 3) ELSE m.vtype END AS INT) AS vtype, m.status
    FROM marked{i} m LEFT JOIN (SELECT src AS v, {_KIND} AS vtype FROM graph{i} GROUP BY src) n ON n.v = m.v WHERE m.status <> 'deleted')"""


def _tips(tip_t: int) -> str:
    return f"""{_CONTIG_GRAPH},
graph0 AS MATERIALIZED (SELECT * FROM contig_graph),
states0 AS MATERIALIZED (SELECT src AS v, CAST({_KIND} AS INT) AS vtype, 'normal' AS status FROM graph0 GROUP BY src){"".join(_tip_round(i, tip_t) for i in range(1, TIP_ROUNDS + 1))},
pruned AS MATERIALIZED (SELECT * FROM graph{TIP_ROUNDS}),
states AS MATERIALIZED (SELECT * FROM states{TIP_ROUNDS})"""


_TIPS = _tips(PARAMETERS.tip_t)

#: The groups of unambiguous vertices left after tips, walked as the paths are; circles are missing, which the derived reads do not have.
_GROUPS = f"""{_TIPS},
g_succ AS MATERIALIZED (
    SELECT g.src AS v, g.src_h AS h, g.dst AS nv, g.dst_h AS nh FROM pruned g JOIN states a ON a.v = g.src JOIN states b ON b.v = g.dst WHERE a.vtype <> 3 AND b.vtype <> 3),
g_nodes AS (SELECT v, h FROM states, (VALUES (false), (true)) AS t(h) WHERE vtype <> 3),
g_walk AS (
    SELECT v AS hv, h AS hh, v, h, CAST(0 AS BIGINT) AS rnk FROM g_nodes n ANTI JOIN g_succ s ON s.nv = n.v AND s.nh = n.h
    UNION ALL
    SELECT w.hv, w.hh, s.nv, s.nh, w.rnk + 1 FROM g_walk w JOIN g_succ s ON s.v = w.v AND s.h = w.h),
g_tails AS (SELECT hv, hh, arg_max(v, rnk) AS tv, min(v) AS least FROM g_walk GROUP BY hv, hh),
g_way AS (SELECT src AS v, arg_max(src_h, (slot, src_h)) AS h FROM pruned GROUP BY src),
g_kept AS (SELECT t.* FROM g_tails t LEFT JOIN g_way w ON w.v = t.hv WHERE hv < tv OR (hv = tv AND hh = coalesce(w.h, false))),
members AS MATERIALIZED (SELECT k.hv AS group_id, k.least, w.v, w.h, w.rnk FROM g_walk w JOIN g_kept k USING (hv, hh))"""

_ASSEMBLED = f"""{_GROUPS},
pieces AS MATERIALIZED (
    SELECT group_id, 2 * rnk AS pos, NULL AS contig_id, CASE WHEN h THEN {_RC.format("v")} ELSE v END AS seq FROM members
    UNION ALL
    SELECT group_id, 2 * rnk + 1, contig_id, CASE WHEN rev THEN {_RC.format("seq")} ELSE seq END FROM members JOIN pruned ON src = v AND src_h = h JOIN filtered USING (contig_id)
    UNION ALL
    SELECT group_id, -1, contig_id, CASE WHEN rev THEN seq ELSE {_RC.format("seq")} END FROM members JOIN pruned ON src = v AND src_h = NOT h JOIN filtered USING (contig_id) WHERE rnk = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pos) AS n FROM pieces),
stitched AS (SELECT string_agg(CASE WHEN n = 1 THEN seq ELSE substr(seq, {K}) END, '' ORDER BY n) AS seq FROM placed GROUP BY group_id),
beside AS (
    SELECT seq FROM filtered
    WHERE contig_id IN (SELECT contig_id FROM pruned JOIN states ON v = src WHERE vtype = 3 AND contig_id IS NOT NULL)
      AND contig_id NOT IN (SELECT contig_id FROM pieces WHERE contig_id IS NOT NULL)),
assembled AS (SELECT CAST(length(seq) AS INT) AS length, {_canon("seq")} AS seq FROM (FROM stitched UNION ALL FROM beside) WHERE length(seq) > {PARAMETERS.output_contig_t})"""


def _stats_sql(source: str) -> str:
    return f"""lengths AS (SELECT length(seq) AS n, count(*) AS times FROM {source} GROUP BY 1),
        longest_first AS (SELECT n, times, sum(n * times) OVER (ORDER BY n DESC) AS so_far, sum(n * times) OVER () AS total FROM lengths)
        SELECT CAST(coalesce(sum(times), 0) AS BIGINT) AS n_sequences, CAST(coalesce(sum(n * times), 0) AS BIGINT) AS total_bases, CAST(coalesce(max(n), 0) AS INT) AS longest,
               CAST(coalesce(max(n) FILTER (2 * so_far >= total), 0) AS INT) AS n50 FROM longest_first"""


_SV = f"""{_WALKS},
members AS (SELECT hv, hh, v FROM walk),
least_of AS (SELECT hv, hh, min(v) AS group_id FROM members GROUP BY hv, hh)"""

ORACLES: dict[str, str] = {
    "reads_scan": f"WITH {READS} SELECT * FROM reads",
    "n_split": f"WITH {READS}, cut AS (SELECT unnest(string_split(replace(seq, 'GAT', 'N'), 'N')) AS seq FROM reads) SELECT seq, count(*) AS n FROM cut GROUP BY seq",
    "kmer_windows": f"WITH {_windows(K)} SELECT substr(s, 1, 6) AS prefix, count(*) AS n FROM windows GROUP BY 1",
    "revcomp": f"WITH {READS} SELECT read_id, {_RC.format('seq')} AS rc FROM reads",
    "canonical_kplus": f"WITH {_windows(K)} SELECT substr(kp1, 1, 5) AS prefix, count(*) AS n, min(kp1) AS least FROM canon GROUP BY 1",
    "homopolymer_filter": f"WITH {_windows(2)} SELECT kp1, count(*) AS n FROM canon GROUP BY 1",
    "kmer_count": f"WITH {_kplus(K)} SELECT * FROM kplus",
    "kmer_freq_filter": f"WITH {_kplus(K)} SELECT * FROM kplus WHERE cnt >= 3",
    "kmer_count_mod256": f"WITH {_kplus(4)} SELECT kp1, cnt % 256 AS cnt FROM kplus WHERE cnt % 256 >= 1",
    "kmer_count_even": f"WITH {_kplus(12)} SELECT * FROM kplus WHERE cnt >= 2",
    "dbg_edges": f"WITH {_GRAPH} SELECT * FROM edges",
    "dbg_vertices": f"WITH {_GRAPH} SELECT * FROM vertices",
    "dbg_bitmap": f"""WITH {_GRAPH}, per AS (SELECT src AS v, slot, CAST(sum(cnt) AS BIGINT) AS cnt FROM edges GROUP BY ALL)
        SELECT v, bit_or(CAST(1 AS BIGINT) << slot) AS bitmap, string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY slot) AS counts FROM per GROUP BY v""",
    "vertex_types": f"WITH {_GRAPH} SELECT vtype, count(*) AS n FROM types GROUP BY vtype",
    "ambiguous_edges": f"WITH {_GRAPH} SELECT src, src_h, dst, dst_h, cnt FROM typed WHERE src_type = 3 AND dst_type = 3",
    "list_rank_groups": f"WITH RECURSIVE {_WALKS} SELECT w.v, w.hv AS group_id FROM walk w JOIN kept USING (hv, hh)",
    "sv_components": f"WITH RECURSIVE {_SV} SELECT DISTINCT v, group_id FROM members JOIN least_of USING (hv, hh)",
    "contigs": f"WITH RECURSIVE {_WALKS} SELECT contig_id, in_nb, in_h, in_cnt, out_nb, out_h, out_cnt, freq, CAST(length(seq) AS INT) AS length, seq FROM contigs",
    "contig_freq": f"WITH RECURSIVE {_WALKS} SELECT contig_id, freq, CAST(length(seq) AS INT) AS length FROM contigs",
    "bubble_pairs": f"WITH RECURSIVE {_BUBBLES} SELECT * FROM pairs",
    "bubble_filter": f"WITH RECURSIVE {_FILTERED} SELECT contig_id, CAST(length(seq) AS INT) AS length, {_canon('seq')} AS seq FROM filtered",
    "tip_contigs": f"WITH RECURSIVE {_FILTERED} SELECT contig_id, CAST(length(seq) AS INT) AS length FROM filtered WHERE length(seq) <= {K - 1 + PARAMETERS.tip_t} AND (in_nb IS NULL OR out_nb IS NULL)",
    "contig_graph": f"WITH RECURSIVE {_CONTIG_GRAPH} SELECT src, src_h, dst, dst_h, contig_id, length FROM contig_graph",
    "tip_removal": f"WITH RECURSIVE {_TIPS} SELECT * FROM states",
    "tip_removal_edges": f"WITH RECURSIVE {_TIPS} SELECT src, src_h, dst, dst_h, contig_id, length FROM pruned",
    "tip_removal_long": f"WITH RECURSIVE {_tips(LONG_TIP)} SELECT * FROM states",
    "tip_removal_long_edges": f"WITH RECURSIVE {_tips(LONG_TIP)} SELECT src, src_h, dst, dst_h, contig_id, length FROM pruned",
    "ambi_groups": f"WITH RECURSIVE {_GROUPS} SELECT v, group_id, false AS is_cycle FROM members",
    "ambi_components": f"WITH RECURSIVE {_GROUPS} SELECT v, least AS group_id FROM members",
    "assemble": f"WITH RECURSIVE {_ASSEMBLED} SELECT * FROM assembled",
    "assemble_fasta": f"WITH RECURSIVE {_ASSEMBLED} SELECT concat('>contig-', row_number() OVER (ORDER BY seq), chr(10), seq) AS value FROM assembled",
    "assembly_stats": f"WITH RECURSIVE {_ASSEMBLED}, {_stats_sql('assembled')}",
    "contig_stats": f"WITH RECURSIVE {_FILTERED}, {_stats_sql('filtered')}",
    "terasort_order": "SELECT l_extendedprice, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS pos FROM lineitem",
    "pregel_min_label": """WITH m AS (SELECT c_nationkey + 1000000 AS b, min(c_custkey) AS label FROM customer GROUP BY 1)
        SELECT c_custkey AS id, label FROM customer JOIN m ON b = c_nationkey + 1000000 UNION ALL SELECT CAST(b AS BIGINT), label FROM m""",
    "message_combine": f"WITH {_GRAPH} SELECT dst, min(cnt) AS least, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS n FROM edges GROUP BY dst",
    "aggregator_and": f"WITH {_GRAPH} SELECT bool_and(vtype = 2) AS all_unambiguous, count(*) FILTER (vtype = 3) AS n_ambiguous, CAST(sum(d_l + d_h) AS BIGINT) AS n_messages, bit_or(vtype) AS kinds FROM types",
    "edit_distance": "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INT) AS dist, CAST(CASE WHEN levenshtein(p_name, p_type) <= 12 THEN levenshtein(p_name, p_type) ELSE -1 END AS INT) AS bounded FROM part",
    "union_inputs": f"WITH {READS}, u AS (SELECT seq FROM reads UNION ALL SELECT {_RC.format('seq')} FROM reads) SELECT substr(seq, 1, 4) AS prefix, count(*) AS n FROM u GROUP BY 1",
}
