"""Registered queries over domain views of the given tables, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varspan.functions import calls as C
from varspan.functions import cigar
from varspan.jobs import records
from varspan.jobs.detect import call_reads, call_variants, split_read_events
from varspan.operators import cluster, compare, consensus, depth, events, kmers, linkage, positions, reads, rescue, signatures
from varspan.operators.ranges import overlap_join
from varspan.params import PRESETS, replace
from varspan.sources import alignments, intervals, reference, vcf
from varspan.sources.tables import kept

P = PRESETS["hifi"]
ONE = "*"

SIG = """sig AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 'target' ELSE 'base' END AS sample, concat('chr', CAST(l_partkey % 5 AS string)) AS chrom, l_partkey AS site,
    CASE l_partkey % 4 WHEN 1 THEN 'I' WHEN 2 THEN 'V' ELSE 'D' END AS op, CAST(l_partkey * 5000 + 10000 + (l_orderkey % 41) AS bigint) AS ref_start,
    CAST(60 + p_size * 20 + (l_orderkey % 7) AS bigint) AS length, l_orderkey AS read_id, CAST(round(l_discount * 100) AS int) * 6 AS mapq
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""
ALN = """aln AS (
  SELECT DISTINCT md5(concat_ws('|', CAST(l_orderkey AS string), CAST(l_linenumber AS string), CAST(l_partkey AS string), CAST(l_suppkey AS string), CAST(CAST(l_quantity AS int) AS string), l_linestatus)) AS aln_id,
    l_orderkey AS read_id, concat('chr', CAST(l_suppkey % 5 AS string)) AS chrom, CAST(l_partkey * 500 + l_linenumber * 37 + 1 AS bigint) AS ref_start,
    concat(CAST(CAST(l_quantity AS int) * 10 AS string), 'M', CAST(CAST(l_quantity AS int) + 20 AS string), CASE WHEN l_linestatus = 'O' THEN 'D' ELSE 'I' END, CAST(CAST(l_quantity AS int) * 8 AS string), 'M') AS cigar
  FROM lineitem)"""
#: What the SQL of later views builds on. Each view's text is the same for both engines, or written for DuckDB alone.
TOK = """tok AS (SELECT *, CAST(regexp_extract(cigar, '^(\\d+)M(\\d+)([ID])(\\d+)M$', 1) AS bigint) AS m1, CAST(regexp_extract(cigar, '^(\\d+)M(\\d+)([ID])(\\d+)M$', 2) AS bigint) AS n,
    regexp_extract(cigar, '^(\\d+)M(\\d+)([ID])(\\d+)M$', 3) AS op, CAST(regexp_extract(cigar, '^(\\d+)M(\\d+)([ID])(\\d+)M$', 4) AS bigint) AS m2 FROM aln)"""
EVENT = """ev AS (SELECT aln_id, read_id, chrom, op, n AS length, CASE WHEN op = 'I' THEN ref_start + m1 - 1 ELSE ref_start + m1 END AS ref_start,
    CASE WHEN op = 'I' THEN ref_start + m1 - 1 ELSE ref_start + m1 + n - 1 END AS ref_end, m1 AS read_start FROM tok WHERE n >= 30)"""
OK = "ok AS (SELECT * FROM sig WHERE sample <> 'target' OR mapq >= 20)"
#: Sites are far apart and alike within (FIXTURES), so the greedy's clusters are the sites.
SITE = """votes AS (SELECT sample, chrom, op, site, ref_start, length, read_id FROM ok),
vs AS (SELECT sample, chrom, op, site, ref_start AS v, count(*) AS n FROM votes GROUP BY ALL),
vl AS (SELECT sample, chrom, op, site, length AS v, count(*) AS n FROM votes GROUP BY ALL),
md AS (SELECT sample, chrom, op, site, list_sort(list(ref_start))[CAST(floor(count(*) / 2) AS int) + 1] AS ms, list_sort(list(length))[CAST(floor(count(*) / 2) AS int) + 1] AS ml, count(DISTINCT read_id) AS support FROM votes GROUP BY ALL),
ts AS (SELECT sample, chrom, op, site, first(v ORDER BY n DESC, v) AS v, max(n) AS n FROM vs GROUP BY ALL),
tl AS (SELECT sample, chrom, op, site, first(v ORDER BY n DESC, v) AS v, max(n) AS n FROM vl GROUP BY ALL),
con AS (SELECT sample, chrom, op, site, CASE WHEN ts.n >= 5 THEN ts.v ELSE ms END AS start, CASE WHEN tl.n >= 5 THEN tl.v ELSE ml END AS length, support
  FROM md JOIN ts USING (sample, chrom, op, site) JOIN tl USING (sample, chrom, op, site)),
con2 AS (SELECT *, CASE WHEN op = 'I' THEN start ELSE start + length END AS "end" FROM con),
calls AS (SELECT * FROM con2 WHERE CASE WHEN sample = 'target' THEN length BETWEEN 50 AND 50000 AND support >= 5 ELSE length >= 30 END)"""
SPAN = "span AS (SELECT sample, chrom, read_id, ref_start - 500 AS lo, ref_start + length + 500 AS hi FROM sig)"
SEG = """un0 AS (SELECT *, max(hi) OVER (PARTITION BY sample, chrom, read_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM span),
un1 AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom, read_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM un0),
un AS (SELECT sample, chrom, read_id, min(lo) AS lo, max(hi) AS hi FROM un1 GROUP BY sample, chrom, read_id, run),
ed AS (SELECT sample, chrom, edge, sum(d) AS d FROM (SELECT sample, chrom, lo AS edge, 1 AS d FROM un UNION ALL SELECT sample, chrom, hi + 1, -1 FROM un) GROUP BY ALL HAVING sum(d) <> 0),
seg AS (SELECT * FROM (SELECT sample, chrom, edge AS lo, lead(edge) OVER (PARTITION BY sample, chrom ORDER BY edge) - 1 AS hi, CAST(sum(d) OVER (PARTITION BY sample, chrom ORDER BY edge) AS bigint) AS depth FROM ed) WHERE depth > 0)"""
VAF = "CASE WHEN depth > 0 THEN CAST(printf('%.2f', least(1.0::double, support::double / depth)) AS double) ELSE 1.0 END"
GT = "CASE WHEN {0} >= 0.8 THEN '1/1' WHEN {0} >= 0.2 THEN '0/1' ELSE '0/0' END"
CALLED = f"""dp AS (SELECT c.sample, c.site, coalesce(max(s.depth), 0) AS depth FROM calls c LEFT JOIN seg s ON s.sample = c.sample AND s.chrom = c.chrom AND s.lo <= c.start + 4 AND s.hi >= c.start - 5 GROUP BY ALL),
called0 AS (SELECT c.*, dp.depth FROM calls c JOIN dp USING (sample, site)),
called AS (SELECT *, {VAF} AS vaf FROM called0)"""


def _sql(*views: str, select: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + select


def _view(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    for t in ("lineitem", "part"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"WITH {text} SELECT * FROM {name}")


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SIG, "sig")


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _view(spark, sf_dir, ALN, "aln")
    return a.withColumn("ref_end", F.col("ref_start") + cigar.ref_span(cigar.tokens(F.col("cigar"))) - 1)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig(spark, sf_dir).select("sample", "chrom", "read_id", (F.col("ref_start") - 500).alias("lo"), (F.col("ref_start") + F.col("length") + 500).alias("hi"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus calls by site, as the clustering of the fixture gives them."""
    ok = signatures.usable_reads(sig(spark, sf_dir), P)
    return cluster.passing(cluster.consensus(ok, ["sample", "chrom", "op", "site"], P), P)


def called(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir).withColumn("id", F.concat_ws("-", "sample", "site"))
    at = depth.depth_around(c.select("id", "sample", "chrom", F.col("start").alias("pos")), depth.segments(spans(spark, sf_dir))).select("id", "depth")
    return c.join(at, "id").withColumn("vaf", C.vaf(F.col("support"), F.col("depth")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


AE = f"{ALN}, {TOK}, a AS (SELECT *, ref_start + m1 + m2 + CASE WHEN op = 'D' THEN n ELSE 0 END - 1 AS ref_end FROM tok)"


@query(_sql(AE, "iv AS (SELECT concat('chr', CAST(p_partkey % 5 AS string)) AS chrom, p_partkey * 500 AS s, p_partkey * 500 + 300 * (p_size % 4) AS e FROM part WHERE p_partkey % 3 = 0)", select="SELECT aln_id, ref_start, ref_end FROM a WHERE EXISTS (SELECT 1 FROM iv WHERE iv.chrom = a.chrom AND s < e AND s + 1 <= ref_end AND e >= ref_start)"))
def q_interval_scan(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 3 = 0")
    at = F.col("p_partkey") * 500
    bed = p.select(F.concat(F.lit("chr"), F.col("p_partkey") % 5).alias("chrom"), at.alias("start"), (at + 300 * (F.col("p_size") % 4)).alias("end"))
    return intervals.in_intervals(aln(spark, d), bed, 2000).select("aln_id", "ref_start", "ref_end")


@query(_sql(AE, select="SELECT aln_id, ref_start, ref_end FROM a WHERE chrom = 'chr2' AND ref_start <= 60000 AND ref_end >= 20000"))
def q_scan_region(spark, d):
    return intervals.in_region(aln(spark, d), "chr2", 20_000, 60_000).select("aln_id", "ref_start", "ref_end")


@query(_sql(SIG, select='SELECT chrom, max(ref_start + length) AS "end", count(*) AS n_intervals FROM sig GROUP BY chrom'))
def q_access_intervals(spark, d):
    return intervals.chrom_ends(sig(spark, d).select("chrom", F.col("ref_start").alias("start"), (F.col("ref_start") + F.col("length")).alias("end")))


@query(_sql(AE, select="SELECT chrom, t * 10000 AS start, (t + 1) * 10000 AS \"end\" FROM (SELECT chrom, unnest(range(CAST(max(ref_end) // 10000 AS bigint) + 1)) AS t FROM a GROUP BY chrom)"))
def q_tiles(spark, d):
    return intervals.tiles(aln(spark, d).groupBy("chrom").agg(F.max("ref_end").alias("length")), 10_000)


@query(_sql(AE, select='SELECT aln_id, chrom, ref_start - 2000 AS start, ref_end + 2000 AS "end" FROM a'))
def q_region_parse(spark, d):
    text = F.concat(F.col("chrom"), F.lit(":"), F.col("ref_start"), F.lit("-"), F.col("ref_end"))
    return aln(spark, d).select("aln_id", intervals.parse_region(text).alias("r")).select("aln_id", "r.*")


@query(_sql(SIG, select="SELECT read_id, chrom, ref_start, '+' AS strand, concat(CAST(length AS string), 'M') AS cigar, mapq FROM sig WHERE mapq >= 20"))
def q_sa_parse(spark, d):
    entry = F.concat_ws(",", "chrom", F.col("ref_start").cast("string"), F.lit("+"), F.concat(F.col("length"), F.lit("M")), F.col("mapq").cast("string"), F.lit("0"))
    tags = sig(spark, d).groupBy("read_id").agg(F.concat(F.array_join(F.collect_list(entry), ";"), F.lit(";")).alias("sa"))
    return alignments.other_alignments(tags, P.min_mapq)


@query(_sql(ALN, TOK, select="SELECT aln_id, 1 AS k, m1 AS n, 'M' AS op FROM tok UNION ALL SELECT aln_id, 2, n, op FROM tok UNION ALL SELECT aln_id, 3, m2, 'M' FROM tok"))
def q_cigar_tokens(spark, d):
    t = aln(spark, d).select("aln_id", F.posexplode(cigar.without_clips(cigar.tokens(F.col("cigar")))).alias("k", "t"))
    return t.select("aln_id", (F.col("k") + 1).alias("k"), "t.n", "t.op")


@query(_sql(ALN, TOK, select="SELECT aln_id, ref_start + m1 + m2 + CASE WHEN op = 'D' THEN n ELSE 0 END - 1 AS ref_end, m1 + m2 + CASE WHEN op = 'I' THEN n ELSE 0 END - 1 AS read_end FROM tok"))
def q_cigar_ends(spark, d):
    return aln(spark, d).select("aln_id", "ref_end", (cigar.read_span(cigar.tokens(F.col("cigar"))) - 1).alias("read_end"))


@query(_sql(AE, select="SELECT aln_id, 1.0::double / (ref_end - ref_start) AS ratio FROM a"))
def q_mismatch_ratio(spark, d):
    return aln(spark, d).select("aln_id", cigar.mismatch_ratio(F.col("cigar"), F.col("ref_start"), F.col("ref_end")).alias("ratio"))


@query(_sql(ALN, TOK, EVENT, select="SELECT aln_id, op, length, ref_start, ref_end, read_start FROM ev WHERE length >= 50"))
def q_intra_signatures(spark, d):
    return signatures.within_reads(aln(spark, d), P).where("not shorter").select("aln_id", "op", "length", "ref_start", "ref_end", "read_start")


@query(_sql(ALN, TOK, EVENT, select="SELECT chrom, op, length < 50 AS shorter, count(*) AS n, CAST(sum(length) AS bigint) AS total FROM ev GROUP BY ALL"))
def q_short_sig(spark, d):
    e = signatures.within_reads(aln(spark, d), P)
    return e.groupBy("chrom", "op", "shorter").agg(F.count(ONE).alias("n"), F.sum("length").alias("total"))


@query(_sql(SIG, OK, select="SELECT sample, chrom, op, count(*) AS n, CAST(sum(mapq) AS bigint) AS mapq FROM ok GROUP BY ALL"))
def q_read_filter(spark, d):
    return signatures.usable_reads(sig(spark, d), P).groupBy("sample", "chrom", "op").agg(F.count(ONE).alias("n"), F.sum("mapq").alias("mapq"))


FLAG = """fl AS (SELECT *, CASE WHEN read_id % 7 = 0 THEN 256 WHEN read_id % 7 = 1 THEN 4 WHEN read_id % 7 = 2 THEN 2048 ELSE 16 END AS flag FROM sig),
ac AS (SELECT DISTINCT chrom FROM sig WHERE chrom <> 'chr3')"""


@query(_sql(SIG, FLAG, select="""SELECT sample, chrom, flag, count(*) AS n FROM fl WHERE flag <> 4 AND chrom IN (SELECT chrom FROM ac) AND (sample <> 'target' OR (flag <> 256 AND mapq >= 20))
  AND (CASE WHEN op = 'D' THEN 2 ELSE 1 END) / (length + CASE WHEN op = 'D' THEN 30 ELSE 0 END)::double < 0.04 GROUP BY ALL"""))
def q_align_filter(spark, d):
    r = F.col("read_id") % 7
    x = sig(spark, d).withColumns({
        "flag": F.when(r == 0, 256).when(r == 1, 4).when(r == 2, 2048).otherwise(16),
        "cigar": F.when(F.col("op") == "D", F.concat(F.lit("10M1I5M30D"), F.col("length") - 15, F.lit("M"))).otherwise(F.concat(F.lit("10M1I"), F.col("length") - 10, F.lit("M"))),
        "ref_end": F.col("ref_start") + F.col("length") + F.when(F.col("op") == "D", 30).otherwise(0) - 1,
    })
    access = x.where("chrom <> 'chr3'").select("chrom")
    return signatures.usable_alignments(x, access, P, mismatch_filter=True).groupBy("sample", "chrom", "flag").agg(F.count(ONE).alias("n"))


@query(_sql(SIG, """pr AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY sample, ref_start, length, op, site, mapq) - 1 AS k FROM sig),
pm AS (SELECT read_id, sample FROM pr WHERE k = 0),
sa AS (SELECT pr.*, pm.sample AS owner, CASE WHEN pr.site % 2 = 0 THEN '-' ELSE '+' END AS tag, CASE WHEN pr.read_id % 2 = 0 THEN '-' ELSE '+' END AS own FROM pr JOIN pm USING (read_id))""", select="""SELECT read_id, chrom, ref_start, ref_start + length + 29 AS ref_end, CASE WHEN k = 0 OR tag = own THEN 21 ELSE 51 END AS read_start,
  CASE WHEN k = 0 OR tag = own THEN 20 ELSE 50 END + length AS read_end, CASE WHEN k = 0 OR tag = own THEN '+' ELSE '-' END AS strand, k = 0 AS is_primary, count(*) AS n
  FROM sa WHERE chrom <> 'chr3' AND (k = 0 OR owner <> 'target' OR mapq >= 20) GROUP BY ALL"""))
def q_split_alignments(spark, d):
    w = Window.partitionBy("read_id").orderBy("sample", "ref_start", "length", "op", "site", "mapq")
    x = sig(spark, d).withColumns({"k": F.row_number().over(w), "cigar": F.concat(F.lit("20S"), F.col("length") - 5, F.lit("M30D5M50S"))})
    tag = F.concat_ws(",", "chrom", F.col("ref_start").cast("string"), F.when(F.col("site") % 2 == 0, "-").otherwise("+"), "cigar", F.col("mapq").cast("string"), F.lit("0"))
    sa = x.where("k > 1").groupBy("read_id").agg(F.concat(F.array_join(F.array_sort(F.collect_list(tag)), ";"), F.lit(";")).alias("sa"))
    reads_ = x.where("k = 1").join(sa, "read_id", "left").withColumn("flag", F.when(F.col("read_id") % 2 == 0, 16).otherwise(0))
    out = alignments.split_alignments(reads_, x.where("chrom <> 'chr3'").select("chrom"), P)
    return out.groupBy("read_id", "chrom", "ref_start", "ref_end", "read_start", "read_end", "strand", "is_primary").agg(F.count(ONE).alias("n"))


PAIR = "pr AS (SELECT x.aln_id AS a, y.aln_id AS b, x.ref_start AS s1, x.ref_end AS e1, y.ref_start AS s2, y.ref_end AS e2 FROM a x JOIN a y ON x.chrom = y.chrom AND x.read_id = y.read_id AND x.aln_id < y.aln_id)"
CLASS = """CASE WHEN s1 = s2 AND e1 = e2 THEN 'non_overlap' WHEN s2 - 50 <= s1 AND s1 < e1 AND e1 <= e2 + 50 THEN 'a_in_b' WHEN s1 - 50 <= s2 AND s2 < e2 AND e2 <= e1 + 50 THEN 'b_in_a'
 WHEN s1 < s2 AND s2 < e1 AND e1 < e2 THEN 'a_before_b' WHEN s2 < s1 AND s1 < e2 AND e2 < e1 THEN 'b_before_a' ELSE 'non_overlap' END"""


@query(_sql(AE, PAIR, select=f"SELECT a, b, {CLASS} AS kind FROM pr"))
def q_overlap_class(spark, d):
    x = aln(spark, d)
    left = x.select("chrom", "read_id", F.col("aln_id").alias("a"), F.col("ref_start").alias("s1"), F.col("ref_end").alias("e1"))
    right = x.select("chrom", "read_id", F.col("aln_id").alias("b"), F.col("ref_start").alias("s2"), F.col("ref_end").alias("e2"))
    both = left.join(right, ["chrom", "read_id"]).where("a < b")
    return both.select("a", "b", C.overlap_class(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")).alias("kind"))


#: Sites of a read are put on a short reference, so that runs occur.
RUNS = """m0 AS (SELECT concat(CAST(read_id AS string), '-', sample) AS aln_id, chrom, op, site % 40 * 700 + read_id % 41 AS ref_start, length,
  CASE WHEN op = 'I' THEN site % 40 * 700 + read_id % 41 ELSE site % 40 * 700 + read_id % 41 + length END AS ref_end FROM (SELECT *, 'chr' AS c0 FROM sig)),
m1 AS (SELECT *, CASE WHEN lag(op) OVER w = op AND op IN ('D', 'I') AND abs(ref_start - lag(ref_end) OVER w) <= 1000 THEN 0 ELSE 1 END AS fresh, row_number() OVER w AS k FROM m0
  WINDOW w AS (PARTITION BY aln_id ORDER BY ref_start, op, length, ref_end, chrom)),
m2 AS (SELECT *, sum(fresh) OVER (PARTITION BY aln_id ORDER BY k) AS run FROM m1),
m3 AS (SELECT aln_id, run, first(k ORDER BY CASE WHEN op = 'D' THEN -length ELSE 0 END, k) AS top FROM m2 GROUP BY aln_id, run),
m4 AS (SELECT m2.*, top FROM m2 JOIN m3 USING (aln_id, run))"""


@query(_sql(SIG, RUNS, select="""SELECT aln_id, op, CAST(max(CASE WHEN k = top THEN ref_start END) - sum(CASE WHEN op = 'D' AND k < top THEN length ELSE 0 END) AS bigint) AS ref_start,
  CAST(max(CASE WHEN k = top THEN ref_end END) + sum(CASE WHEN op = 'D' AND k > top THEN length ELSE 0 END) AS bigint) AS ref_end, CAST(sum(length) AS bigint) AS length, count(*) AS n_merged FROM m4 GROUP BY aln_id, op, run"""))
def q_merge_nearby(spark, d):
    at = F.col("site") % 40 * 700 + F.col("read_id") % 41
    s = sig(spark, d).select(F.concat_ws("-", F.col("read_id").cast("string"), "sample").alias("aln_id"), F.lit("chr").alias("chrom"), "op", at.alias("ref_start"), F.when(F.col("op") == "I", at).otherwise(at + F.col("length")).alias("ref_end"), "length")
    return signatures.merge_nearby(s, P.merge_gap).drop("chrom")


@query(_sql(SIG, OK, select="SELECT sample, chrom, op, ref_start, length, count(DISTINCT read_id) AS support FROM ok GROUP BY ALL"))
def q_sig_collapse(spark, d):
    return signatures.collapse(signatures.usable_reads(sig(spark, d), P))


@query(_sql(SIG, select="SELECT concat_ws('-', chrom, op, CAST(ref_start AS string), CAST(length AS string)) AS identity, count(*) AS n FROM sig GROUP BY ALL"))
def q_sig_identity(spark, d):
    key = F.concat_ws("-", "chrom", "op", F.col("ref_start").cast("string"), F.col("length").cast("string"))
    return sig(spark, d).groupBy(key.alias("identity")).agg(F.count(ONE).alias("n"))


@query(_sql(SIG, select="SELECT read_id, string_agg(op, '+' ORDER BY ref_start, op, length) AS op, min(ref_start) AS start, max(ref_start + length) AS \"end\", CAST(sum(length) AS bigint) AS length FROM sig GROUP BY read_id"))
def q_hyper_props(spark, d):
    s = sig(spark, d).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("ref_start", "op", "length"))).alias("x"))
    return s.select(
        "read_id", F.array_join(F.transform("x", lambda e: e["op"]), "+").alias("op"), F.array_min(F.transform("x", lambda e: e["ref_start"])).alias("start"),
        F.array_max(F.transform("x", lambda e: e["ref_start"] + e["length"])).alias("end"), F.aggregate("x", F.lit(0).cast("long"), lambda a, e: a + e["length"]).alias("length"),
    )


@query(_sql(SIG, SPAN, SEG, select="SELECT sample, chrom, lo, hi, depth FROM seg"))
def q_depth_segments(spark, d):
    return depth.segments(spans(spark, d))


@query(_sql(SIG, OK, SITE, SPAN, SEG, CALLED, select="SELECT sample, site, depth FROM called"))
def q_depth_at_bkp(spark, d):
    return called(spark, d).select("sample", "site", "depth")


@query(_sql(SIG, SPAN, SEG, "deep AS (SELECT * FROM seg WHERE depth > 25)", """gone AS (SELECT DISTINCT x.sample, x.chrom, x.site, x.read_id, x.ref_start, x.length FROM sig x JOIN deep s ON s.sample = x.sample AND s.chrom = x.chrom
  WHERE x.ref_start BETWEEN s.lo AND s.hi OR (CASE WHEN x.op = 'I' THEN x.ref_start ELSE x.ref_start + x.length END) BETWEEN s.lo AND s.hi)""", select="SELECT sample, chrom, read_id, ref_start, length FROM sig x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.sample = x.sample AND g.chrom = x.chrom AND g.site = x.site AND g.read_id = x.read_id AND g.ref_start = x.ref_start AND g.length = x.length)"))
def q_overcov_filter(spark, d):
    x = sig(spark, d).withColumn("ref_end", F.when(F.col("op") == "I", F.col("ref_start")).otherwise(F.col("ref_start") + F.col("length")))
    return signatures.without_deep(x, depth.segments(spans(spark, d)), 25).select("sample", "chrom", "read_id", "ref_start", "length")


@query(_sql(SIG, OK, SITE, SPAN, select="SELECT c.sample, c.site, count(DISTINCT s.read_id) AS reads FROM calls c JOIN span s ON s.sample = c.sample AND s.chrom = c.chrom AND s.lo < c.start - 10 AND s.hi > c.start + 10 GROUP BY ALL"))
def q_spanning_reads(spark, d):
    c = calls(spark, d).select("sample", "chrom", "site", (F.col("start") - 10).alias("lo"), (F.col("start") + 10).alias("hi"))
    s = spans(spark, d).select("sample", "chrom", "read_id", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    hit = overlap_join(c, s, ["sample", "chrom"], 2000).where("lo2 < lo and hi2 > hi")
    return hit.groupBy("sample", "site").agg(F.countDistinct("read_id").alias("reads"))


@query(_sql(SIG, OK, select="SELECT sample, chrom, op, min(ref_start) AS first, max(ref_start) AS last, count(DISTINCT (ref_start, length)) AS n FROM ok GROUP BY sample, chrom, op, site"))
def q_coarse_cluster(spark, d):
    c = cluster.coarse_clusters(signatures.collapse(signatures.usable_reads(sig(spark, d), P)), P)
    return c.groupBy("sample", "chrom", "op", "island", "cluster").agg(F.min("ref_start").alias("first"), F.max("ref_start").alias("last"), F.count(ONE).alias("n")).drop("island", "cluster")


#: A third of a site's reads have another op, that doesn't keep them from the site's cluster.
MIXED = "mx AS (SELECT sample, chrom, site, CASE WHEN read_id % 3 > 0 THEN op WHEN op = 'D' THEN 'V' WHEN op = 'V' THEN 'D' ELSE 'I+V' END AS op, ref_start, length, read_id FROM ok)"


@query(_sql(SIG, OK, MIXED, "ct AS (SELECT sample, chrom, site, op, count(DISTINCT read_id) AS support FROM mx GROUP BY ALL)", "cl AS (SELECT sample, chrom, site, min(ref_start) AS first, max(ref_start) AS last FROM mx GROUP BY ALL)", select="SELECT sample, chrom, first, last, op, support FROM cl JOIN ct USING (sample, chrom, site)"))
def q_mixed_cluster(spark, d):
    other = F.when(F.col("read_id") % 3 > 0, F.col("op")).when(F.col("op") == "D", "V").when(F.col("op") == "V", "D").otherwise("I+V")
    x = signatures.usable_reads(sig(spark, d), P).withColumn("op", other)
    c = cluster.coarse_clusters(signatures.collapse(x), P).drop("support")
    keys = ["sample", "chrom", "island", "cluster"]
    span = c.groupBy(*keys).agg(F.min("ref_start").alias("first"), F.max("ref_start").alias("last"))
    members = x.join(c, ["sample", "chrom", "op", "ref_start", "length"])
    none = span.select(*keys).withColumn("bonus", F.lit(0))
    return rescue.fine_split(members.select(*keys, "op", "read_id"), keys, none, P).join(span, keys).select("sample", "chrom", "first", "last", "op", "support")


#: Three places at each site, 700 apart: their reach makes one island of wide spans, their distance three clusters.
PLACES = "lk AS (SELECT sample, chrom, op, site, read_id % 3 AS place, ref_start + read_id % 3 * 700 AS ref_start, length, read_id FROM ok)"


@query(_sql(SIG, OK, PLACES, select="SELECT sample, chrom, op, min(ref_start) AS first, max(ref_start) AS last, count(DISTINCT (ref_start, length)) AS n, count(DISTINCT (ref_start, length, read_id)) AS support FROM lk GROUP BY sample, chrom, op, site, place"))
def q_linkage(spark, d):
    x = signatures.usable_reads(sig(spark, d), P).withColumn("ref_start", F.col("ref_start") + F.col("read_id") % 3 * 700)
    c = linkage.linkage_clusters(signatures.collapse(x), ["sample", "chrom", "op"])
    g = c.groupBy("sample", "chrom", "op", "island", "cluster").agg(F.min("ref_start").alias("first"), F.max("ref_start").alias("last"), F.count(ONE).alias("n"), F.sum("support").alias("support"))
    return g.drop("island", "cluster")


@query(_sql(SIG, OK, select="SELECT sample, site, list_sort(list(ref_start))[CAST(floor(count(*) / 2) AS int) + 1] AS start, list_sort(list(length))[CAST(floor(count(*) / 2) AS int) + 1] AS length, count(DISTINCT read_id) AS support FROM ok GROUP BY ALL"))
def q_centroid(spark, d):
    return cluster.centroids(signatures.usable_reads(sig(spark, d), P), ["sample", "site"])


@query(_sql(SIG, OK, SITE, select='SELECT sample, site, start, "end", length, support FROM con2'))
def q_consensus_call(spark, d):
    ok = signatures.usable_reads(sig(spark, d), P)
    return cluster.consensus(ok, ["sample", "chrom", "op", "site"], P).select("sample", "site", "start", "end", "length", "support")


@query(_sql(SIG, OK, SITE, select='SELECT sample, site, start, "end", length, support FROM calls'))
def q_call_filter(spark, d):
    return calls(spark, d).select("sample", "site", "start", "end", "length", "support")


@query(_sql(SIG, OK, SITE, select="SELECT sample, site, CASE WHEN count(*) OVER (PARTITION BY sample, chrom, start // 200) > 1 THEN 'POLY' ELSE 'PASS' END AS filter FROM calls"))
def q_poly_flag(spark, d):
    return cluster.mark_poly(calls(spark, d), P).select("sample", "site", "filter")


@query(_sql(SIG, OK, SITE, select='SELECT sample, site, start - (length + 1) * 7 // 10 AS "left", "end" + (length + 1) * 7 // 10 AS "right" FROM calls'))
def q_extend(spark, d):
    return cluster.extended(calls(spark, d)).select("sample", "site", "left", "right")


@query(_sql(SIG, select=f"SELECT read_id, site, {GT.format('mapq / 60.0')} AS gt FROM sig"))
def q_genotype(spark, d):
    return sig(spark, d).select("read_id", "site", C.genotype(F.col("mapq") / 60).alias("gt"))


@query(_sql(SIG, OK, SITE, SPAN, SEG, CALLED, select="SELECT sample, site, vaf FROM called"))
def q_vaf(spark, d):
    return called(spark, d).select("sample", "site", "vaf")


@query(_sql(SIG, OK, SITE, SPAN, SEG, CALLED, select=f"SELECT sample, site, greatest(depth - support, 0) AS dr, support AS dv, {GT.format('vaf')} AS gt FROM called"))
def q_dr_dv(spark, d):
    return called(spark, d).select("sample", "site", C.reference_reads(F.col("depth"), F.col("support")).alias("dr"), F.col("support").alias("dv"), C.genotype(F.col("vaf")).alias("gt"))


SRC = "src AS (SELECT *, CASE WHEN mapq % 4 = 0 THEN NULL WHEN read_id % 3 = 0 THEN 'chrX' ELSE chrom END AS c2, ref_start + (read_id % 9 - 4) * 20 AS s2, CASE WHEN read_id % 2 = 0 THEN '-' ELSE '+' END AS strand FROM sig)"


def _with_source(spark, d):
    return sig(spark, d).withColumns({
        "c2": F.when(F.col("mapq") % 4 == 0, None).when(F.col("read_id") % 3 == 0, "chrX").otherwise(F.col("chrom")),
        "s2": F.col("ref_start") + (F.col("read_id") % 9 - 4) * 20,
        "strand": F.when(F.col("read_id") % 2 == 0, "-").otherwise("+"),
    })


TYPE = """CASE WHEN op = 'D' THEN 'DEL' WHEN op = 'V' THEN 'INV' WHEN c2 IS NULL THEN 'INS'
 WHEN c2 = chrom AND (abs(s2 - ref_start) <= 50 OR abs(s2 + length - ref_start) <= 50) THEN CASE WHEN strand = '-' THEN 'itDUP' ELSE 'tDUP' END
 WHEN strand = '-' THEN 'idDUP' ELSE 'dDUP' END"""


def _typed(spark, d):
    kind = C.variant_type(F.col("op"), F.col("chrom"), F.col("ref_start"), F.col("c2"), F.col("s2"), F.col("s2") + F.col("length"), F.col("strand"), P.min_size)
    return _with_source(spark, d).withColumn("type", kind)


@query(_sql(SIG, SRC, select=f"SELECT {TYPE} AS type, chrom, count(*) AS n FROM src GROUP BY ALL"))
def q_variant_type(spark, d):
    return _typed(spark, d).groupBy("type", "chrom").agg(F.count(ONE).alias("n"))


@query(_sql(SIG, SRC, f"ty AS (SELECT *, {TYPE} AS type FROM src)", "rd AS (SELECT read_id, string_agg(type, '+' ORDER BY ref_start, type) AS kind FROM ty GROUP BY read_id)", select="SELECT read_id, kind, CASE WHEN contains(kind, '+') OR kind IN ('itDUP', 'idDUP') THEN 'CSV' ELSE 'SV' END AS class FROM rd"))
def q_csv_class(spark, d):
    x = _typed(spark, d).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("ref_start", "type"))).alias("x"))
    x = x.select("read_id", F.array_join(F.transform("x", lambda e: e["type"]), "+").alias("kind"))
    return x.withColumn("class", C.is_complex(F.col("kind")))


@query(_sql(SIG, SRC, select="SELECT DISTINCT read_id, site, CASE WHEN strand = '-' THEN concat(']', c2, ':', CAST(s2 AS string), ']N') ELSE concat('[', c2, ':', CAST(s2 AS string), '[N') END AS alt FROM src WHERE c2 IS NOT NULL"))
def q_bnd_alt(spark, d):
    return _with_source(spark, d).where("c2 is not null").select("read_id", "site", C.breakend(F.col("c2"), F.col("s2"), F.col("strand")).alias("alt")).distinct()


@query(_sql(SIG, SRC, f"ty AS (SELECT *, {TYPE} AS type FROM src)", select="SELECT read_id, site, concat_ws('++', type, CAST(length AS string), CASE WHEN type LIKE '%DUP' THEN c2 ELSE chrom END, CAST(CASE WHEN type LIKE '%DUP' THEN s2 ELSE ref_start END AS string), CAST(ref_start + length AS string)) AS bkps FROM ty"))
def q_bkps_encode(spark, d):
    dup = F.col("type").endswith("DUP")
    at = F.when(dup, F.col("s2")).otherwise(F.col("ref_start")).cast("string")
    return _typed(spark, d).select("read_id", "site", F.concat_ws("++", "type", F.col("length").cast("string"), F.when(dup, F.col("c2")).otherwise(F.col("chrom")), at, (F.col("ref_start") + F.col("length")).cast("string")).alias("bkps"))


@query(_sql(SIG, select='SELECT read_id, chrom, min(ref_start) AS pos, max(CASE WHEN op = \'I\' THEN ref_start ELSE ref_start + length END) AS "end", CAST(sum(length) AS bigint) AS svlen FROM sig GROUP BY ALL'))
def q_record_span(spark, d):
    end = F.when(F.col("op") == "I", F.col("ref_start")).otherwise(F.col("ref_start") + F.col("length"))
    return sig(spark, d).groupBy("read_id", "chrom").agg(F.min("ref_start").alias("pos"), F.max(end).alias("end"), F.sum("length").alias("svlen"))


PAIRS = """tg AS (SELECT chrom, site AS target, op, start, length, start - (length + 1) * 7 // 10 AS lo, "end" + (length + 1) * 7 // 10 AS hi FROM calls WHERE sample = 'target'),
bs AS (SELECT chrom, site AS base, op AS op2, start AS start2, length AS length2, start AS lo2, "end" AS hi2 FROM calls WHERE sample = 'base'),
cand AS (SELECT * FROM tg JOIN bs USING (chrom) WHERE lo <= hi2 AND lo2 <= hi)"""
SCORE = """sc0 AS (SELECT *, CAST(round_even(100.0::double * least(length, length2) / greatest(length, length2), 0) AS bigint) AS size,
  CAST(floor(100.0::double * greatest(0, least(start + greatest(length, 1000), start2 + greatest(length2, 1000)) - greatest(start, start2)) / greatest(length, 1000)) AS bigint) AS pos FROM cand),
sc AS (SELECT *, CASE WHEN op = op2 AND size / 100.0::double >= 0.7 AND pos > 0 THEN 100 + size + pos ELSE 0 END AS score FROM sc0)"""


def _pairs(spark, d):
    c = cluster.extended(calls(spark, d))
    return compare.base_candidates(c.where("sample = 'target'"), c.where("sample = 'base'"), P)


@query(_sql(SIG, OK, SITE, PAIRS, select="SELECT target, base, start, start2 FROM cand"))
def q_target_base_range(spark, d):
    return _pairs(spark, d).select("target", "base", "start", "start2")


@query(_sql(SIG, OK, SITE, PAIRS, SCORE, select="SELECT target, base, score FROM (SELECT *, max(score) OVER (PARTITION BY target) AS top FROM sc) WHERE score > 0 AND score = top"))
def q_best_base_match(spark, d):
    return compare.best_matches(compare.scored(_pairs(spark, d), P)).select("target", "base", "score")


INH = "CASE WHEN {b} = 0 THEN 'NewCOMP' WHEN abs({t} - {b}) >= 0.3 THEN 'NewALLELE' ELSE 'Germline' END"
BOTH = "tb AS (SELECT t.site, t.chrom, t.vaf AS tv, coalesce(b.vaf, 0.0) AS bv FROM (SELECT * FROM called WHERE sample = 'target') t LEFT JOIN (SELECT * FROM called WHERE sample = 'base') b ON t.site = b.site)"


def _both(spark, d):
    c = called(spark, d)
    b = c.where("sample = 'base'").select("site", F.col("vaf").alias("bv"))
    return c.where("sample = 'target'").select("site", "chrom", "support", F.col("vaf").alias("tv")).join(b, "site", "left").withColumn("bv", F.coalesce("bv", F.lit(0.0)))


@query(_sql(SIG, OK, SITE, SPAN, SEG, CALLED, BOTH, select=f"SELECT site, tv, bv, {INH.format(t='tv', b='bv')} AS label FROM tb"))
def q_inheritype_vaf(spark, d):
    return _both(spark, d).select("site", "tv", "bv", C.inheritance(F.col("tv"), F.col("bv"), P.diff_freq, False).alias("label"))


COMPARE = """bx AS (SELECT site, 'father' AS base, vaf, depth, support FROM called WHERE sample = 'base' UNION ALL SELECT site, 'mother', vaf, depth, support FROM called WHERE sample = 'base' AND site % 2 = 0),
nb AS (SELECT unnest(['father', 'mother']) AS base), mo AS (SELECT unnest(['denovo', 'somatic']) AS mode),
cx AS (SELECT t.site, mode, nb.base, t.vaf AS tv, coalesce(b.vaf, 0.0) AS bv, b.depth, b.support FROM (SELECT * FROM called WHERE sample = 'target') t CROSS JOIN nb CROSS JOIN mo LEFT JOIN bx b ON b.site = t.site AND b.base = nb.base),
lx AS (SELECT *, CASE WHEN bv = 0 AND (mode = 'denovo' OR tv >= 0.3) THEN 'NewCOMP' WHEN abs(tv - bv) >= 0.3 THEN 'NewALLELE' ELSE 'Germline' END AS label FROM cx)"""


@query(_sql(SIG, OK, SITE, SPAN, SEG, CALLED, COMPARE, select=f"SELECT site, mode, base, label, CASE WHEN label = 'Germline' THEN {GT.format('tv')} ELSE {GT.format('bv')} END AS gt, CASE WHEN depth IS NULL THEN 'NA' ELSE CAST(greatest(depth - support, 0) AS string) END AS dr, coalesce(CAST(support AS string), 'NA') AS dv FROM lx"))
def q_compare_calls(spark, d):
    c = called(spark, d).withColumns({"gt": C.genotype(F.col("vaf")), "dr": C.reference_reads(F.col("depth"), F.col("support")), "dv": F.col("support"), "id": F.col("site")})
    base = c.where("sample = 'base'")
    bases = base.withColumn("base", F.lit("father")).unionByName(base.where("site % 2 = 0").withColumn("base", F.lit("mother")))
    modes = [compare.compare_calls(c.where("sample = 'target'"), bases, ["father", "mother"], P, mode == "somatic").withColumn("mode", F.lit(mode)) for mode in ("denovo", "somatic")]
    return modes[0].unionByName(modes[1]).withColumnRenamed("id", "site")


@query(_sql(SIG, OK, SITE, SPAN, SEG, CALLED, BOTH, f"lb AS (SELECT site // 10 AS grp, {INH.format(t='tv', b='bv')} AS label FROM tb)", select="SELECT grp, CASE WHEN count(DISTINCT label) = 1 THEN min(label) WHEN avg(CASE WHEN label = 'Germline' THEN 1.0 ELSE 0.0 END) >= 0.2 THEN 'Germline' WHEN avg(CASE WHEN label = 'NewALLELE' THEN 1.0 ELSE 0.0 END) >= 0.2 THEN 'NewALLELE' ELSE 'NewCOMP' END AS label FROM lb GROUP BY grp"))
def q_inheritype_final(spark, d):
    x = _both(spark, d).select(F.floor(F.col("site") / 10).alias("grp"), C.inheritance(F.col("tv"), F.col("bv"), P.diff_freq, False).alias("label"))
    return compare.final_label(x, ["grp"])


@query(_sql(SIG, OK, SITE, SPAN, SEG, CALLED, select=f"SELECT chrom, op, max({GT.format('vaf')}) AS gt FROM called WHERE sample = 'base' GROUP BY ALL"))
def q_base_gt(spark, d):
    return called(spark, d).where("sample = 'base'").groupBy("chrom", "op").agg(F.max(C.genotype(F.col("vaf"))).alias("gt"))


BNDS = """bn AS (SELECT DISTINCT read_id * 1000000 + site AS id, CASE WHEN read_id % 2 = 0 THEN chrom ELSE concat('chr', CAST((site + 1) % 5 AS string)) END AS chrom, CASE WHEN read_id % 2 = 0 THEN ref_start ELSE ref_start + 700 END AS pos,
  CASE WHEN read_id % 2 = 0 THEN concat('chr', CAST((site + 1) % 5 AS string)) ELSE chrom END AS chrom2, CASE WHEN read_id % 2 = 0 THEN ref_start + 700 ELSE ref_start END AS pos2, CASE WHEN site % 2 = 0 THEN '-' ELSE '+' END AS strand FROM sig WHERE op = 'V')"""


def _bnds(spark, d):
    even, other = F.col("read_id") % 2 == 0, F.concat(F.lit("chr"), (F.col("site") + 1) % 5)
    pick = lambda a, b: F.when(even, a).otherwise(b)
    far = F.col("ref_start") + 700
    return sig(spark, d).where("op = 'V'").select(
        (F.col("read_id") * 1_000_000 + F.col("site")).alias("id"), pick(F.col("chrom"), other).alias("chrom"), pick(F.col("ref_start"), far).alias("pos"),
        pick(other, F.col("chrom")).alias("chrom2"), pick(far, F.col("ref_start")).alias("pos2"), F.when(F.col("site") % 2 == 0, "-").otherwise("+").alias("strand"),
    ).distinct()


@query(_sql(SIG, BNDS, select="SELECT id, chrom, pos, chrom2, pos2, strand FROM bn x WHERE NOT EXISTS (SELECT 1 FROM bn k WHERE k.id < x.id AND k.strand = '-' AND x.strand = '-' AND k.chrom = x.chrom2 AND k.chrom2 = x.chrom AND abs(k.pos - x.pos2) < 1000 AND abs(k.pos2 - x.pos) < 1000)"))
def q_bnd_dedupe(spark, d):
    return compare.mirrored(_bnds(spark, d), 1000).select("id", "chrom", "pos", "chrom2", "pos2", "strand")


@query(_sql(SIG, SRC, select="SELECT read_id, site, least(ref_start, s2) AS start, greatest(ref_start, s2) AS \"end\", abs(s2 - ref_start) AS length, 'INV' AS type FROM src WHERE c2 = chrom AND strand = '-' AND abs(s2 - ref_start) BETWEEN 50 AND 50000"))
def q_large_inv(spark, d):
    n = F.abs(F.col("s2") - F.col("ref_start"))
    x = _with_source(spark, d).where((F.col("c2") == F.col("chrom")) & (F.col("strand") == "-") & n.between(P.min_size, P.max_size))
    return x.select("read_id", "site", F.least("ref_start", "s2").alias("start"), F.greatest("ref_start", "s2").alias("end"), n.alias("length"), F.lit("INV").alias("type"))


@query(_sql(SIG, OK, SITE, SPAN, SEG, CALLED, select=f"SELECT sample, op, {GT.format('vaf')} AS gt, count(*) AS n FROM called GROUP BY ALL"))
def q_call_counts(spark, d):
    return called(spark, d).groupBy("sample", "op", C.genotype(F.col("vaf")).alias("gt")).agg(F.count(ONE).alias("n"))


LINES = f"""ln AS (SELECT t.site, t.support, CASE WHEN count(*) OVER (PARTITION BY t.chrom, t.start // 200) > 1 THEN 'POLY' ELSE 'PASS' END AS filter,
  concat('DEL_', {INH.format(t='t.vaf', b='coalesce(b.vaf, 0.0)')}, CASE WHEN t.site % 6 = 0 THEN '_NewCOMP_NewCOMP' WHEN t.site % 3 = 0 THEN '_NewCOMP' ELSE '' END) AS line
  FROM (SELECT * FROM called WHERE sample = 'target') t LEFT JOIN (SELECT * FROM called WHERE sample = 'base') b ON t.site = b.site)"""


def _lines(spark, d):
    label = C.inheritance(F.col("tv"), F.col("bv"), P.diff_freq, False)
    more = F.when(F.col("site") % 6 == 0, "_NewCOMP_NewCOMP").when(F.col("site") % 3 == 0, "_NewCOMP").otherwise("")
    start = calls(spark, d).where("sample = 'target'").select("sample", "chrom", "site", "start")
    poly = cluster.mark_poly(start, P).select("site", "filter")
    return _both(spark, d).join(poly, "site").select("site", "support", "filter", F.concat(F.lit("DEL_"), label, more).alias("line"))


def _extract(n: int, least: int) -> str:
    return _sql(SIG, OK, SITE, SPAN, SEG, CALLED, LINES, select=f"SELECT site, support, line FROM ln WHERE filter <> 'POLY' AND support >= {least}" + (f" AND contains(line, '{'_NewCOMP' * n}')" if n else ""))


@query(_extract(2, 8))
def q_extract_denovo(spark, d):
    return vcf.select_new(_lines(spark, d), 2, 8).select("site", "support", "line")


@query(_extract(1, 8))
def q_extract_somatic(spark, d):
    return vcf.select_new(_lines(spark, d), 1, 8).select("site", "support", "line")


@query(_extract(0, 12).replace("filter <> 'POLY' AND ", ""))
def q_extract_support(spark, d):
    return _lines(spark, d).where("support >= 12").select("site", "support", "line")


@query(_sql(SIG, OK, SITE, SPAN, SEG, CALLED, select=f"""SELECT concat_ws(chr(9), chrom, CAST(start AS string), concat(sample, '-', CAST(site AS string)), 'N', concat('<', CASE op WHEN 'D' THEN 'DEL' WHEN 'V' THEN 'INV' ELSE 'INS' END, '>'), '.', 'PASS',
 concat('END=', CAST("end" AS string), ';SVLEN=', CAST(length AS string), ';SVTYPE=', CASE op WHEN 'D' THEN 'DEL' WHEN 'V' THEN 'INV' ELSE 'INS' END, ';SUPPORT=', CAST(support AS string), ';VAF=', printf('%.2f', vaf), ';BKPS=', op), 'GT:DR:DV',
 concat({GT.format('vaf')}, ':', CAST(greatest(depth - support, 0) AS string), ':', CAST(support AS string))) AS line FROM called"""))
def q_vcf_lines(spark, d):
    kind = F.when(F.col("op") == "D", "DEL").when(F.col("op") == "V", "INV").otherwise("INS")
    x = called(spark, d).withColumns({"type": kind, "bkps": F.col("op"), "filter": F.lit("PASS"), "gt": C.genotype(F.col("vaf")), "dr": C.reference_reads(F.col("depth"), F.col("support"))})
    return x.select(vcf.record(x).alias("line"))


@query(_sql(SIG, OK, SITE, SPAN, SEG, CALLED, select=f"""SELECT chrom, start, concat(sample, '-', CAST(site AS string)) AS id, concat('<', CASE op WHEN 'D' THEN 'DEL' WHEN 'V' THEN 'INV' ELSE 'INS' END, '>') AS alt, 'PASS' AS filter, "end", length,
  CASE op WHEN 'D' THEN 'DEL' WHEN 'V' THEN 'INV' ELSE 'INS' END AS type, support, vaf, op AS bkps, {GT.format('vaf')} AS gt, CAST(greatest(depth - support, 0) AS string) AS dr, CAST(support AS string) AS dv FROM called"""))
def q_vcf_fields(spark, d):
    r = q_vcf_lines(spark, d).select(vcf.parsed(F.col("line")).alias("r")).select("r.*")
    return r.withColumn("s", F.col("samples")[0]).select(*[c for c in r.columns if c != "samples"], "s.gt", "s.dr", "s.dv")


@query(_sql(SIG, SRC, select="SELECT DISTINCT read_id, site, c2 AS chrom2, s2 AS pos2, strand AS strand2 FROM src WHERE c2 IS NOT NULL"))
def q_bnd_parse(spark, d):
    return q_bnd_alt(spark, d).select("read_id", "site", C.parsed_breakend(F.col("alt")).alias("e")).select("read_id", "site", "e.*")


@query(_sql(SIG, OK, SITE, SPAN, SEG, CALLED, "lk AS (SELECT sample, site, support * ln(0.05::double) + greatest(depth - support, 0) * ln(1 - 0.05::double) AS a, support * ln(0.5::double) + greatest(depth - support, 0) * ln(1 - 0.5::double) AS b, support * ln(0.95::double) + greatest(depth - support, 0) * ln(1 - 0.95::double) AS c FROM called)", select="SELECT sample, site, CASE WHEN a >= b AND a >= c THEN '0/0' WHEN b >= c THEN '0/1' ELSE '1/1' END AS gt FROM lk"))
def q_binom_gt(spark, d):
    return called(spark, d).select("sample", "site", C.genotype_by_likelihood(C.reference_reads(F.col("depth"), F.col("support")), F.col("support")).alias("gt"))


@query("SELECT doc_id, md5(reverse(translate(regexp_replace(translate(text, 'aeio', 'ACGT'), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))) AS rc FROM documents")
def q_revcomp(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", F.md5(C.reverse_complement(F.translate("text", "aeio", "ACGT"))).alias("rc"))


@query(_sql(SIG, OK, SITE, SPAN, SEG, CALLED, select=f'SELECT sample, chrom, op, start, "end", length, support, depth, vaf, {GT.format("vaf")} AS gt FROM called'))
def q_detect(spark, d):
    return call_variants(sig(spark, d), spans(spark, d), P)


#: A read for each site of an order. By site they show (kind) 0 a deletion, 1 an insertion, 2 an inversion, 3 a step to chrS, 4 one that turns, seen from either end, a copy of the
#: bases before 5 forward and 6 reverse, a copy from chrS 7 forward and 8 reverse, 9 a deletion beside an inversion, 10 a turn further along the chromosome.
READS = """rd0 AS (SELECT sample, chrom, site, ref_start AS r, length AS n, concat(CAST(read_id AS string), '/', CAST(site AS string)) AS read_id, site % 11 AS kind, CASE WHEN site % 11 = 4 THEN ref_start % 2 ELSE 0 END AS form, max(mapq) AS mapq
  FROM sig GROUP BY ALL),
rd AS (SELECT * FROM rd0 WHERE sample <> 'target' OR mapq >= 20),
span AS (SELECT sample, chrom, read_id, CASE WHEN kind IN (1, 3, 4, 7, 8, 10) THEN r - 499 WHEN kind IN (5, 6) THEN r - n - 499 ELSE r - 500 END AS lo,
    CASE WHEN kind IN (0, 2) THEN r + n + 499 WHEN kind IN (3, 4) THEN r WHEN kind = 9 THEN r + n + 599 WHEN kind = 10 THEN r + n + 1499 ELSE r + 500 END AS hi FROM rd
  UNION ALL SELECT sample, 'chrS', read_id, r + 700, CASE WHEN kind IN (3, 4) THEN r + 1199 ELSE r + n + 699 END FROM rd WHERE kind IN (3, 4, 7, 8)),
ce AS (SELECT sample, chrom, site, kind, form, unnest(['start', 'length', 'r', 'after', 'before']) AS f, unnest([CASE WHEN form = 1 THEN r + 1199 ELSE r END, CASE WHEN kind IN (3, 4, 10) THEN 50 ELSE n END, r, r + n, r - n]) AS v FROM rd),
cn AS (SELECT sample, site, form, f, v, count(*) AS n FROM ce GROUP BY ALL),
ct AS (SELECT sample, site, form, f, first(v ORDER BY n DESC, v) AS top, max(n) AS n FROM cn GROUP BY ALL),
cm AS (SELECT sample, chrom, site, kind, form, f, count(*) AS reads, list_sort(list(v))[CAST(floor(count(*) / 2) AS int) + 1] AS mid FROM ce GROUP BY ALL),
cv AS (SELECT sample, chrom, site, kind, form, any_value(reads) AS support, max(CASE WHEN f = 'start' THEN CASE WHEN n >= 5 THEN top ELSE mid END END) AS s, max(CASE WHEN f = 'length' THEN CASE WHEN n >= 5 THEN top ELSE mid END END) AS l,
  max(CASE WHEN f = 'after' THEN CASE WHEN n >= 5 THEN top ELSE mid END END) AS sb, max(CASE WHEN f = 'r' THEN top END) AS tr, max(CASE WHEN f = 'after' THEN top END) AS ta, max(CASE WHEN f = 'before' THEN top END) AS tb FROM cm JOIN ct USING (sample, site, form, f) GROUP BY ALL),
k0 AS (SELECT sample, site, kind, form, support, CASE WHEN form = 1 THEN 'chrS' ELSE chrom END AS chrom, ['D', 'I', 'V', 'B', 'B', 'I', 'I', 'I', 'I', 'D+V', 'B'][kind + 1] AS op, ['DEL', 'INS', 'INV', 'BND', 'BND', 'tDUP', 'itDUP', 'dDUP', 'idDUP', 'DEL+INV', 'BND'][kind + 1] AS type,
  s AS start, sb, l, CASE WHEN kind IN (0, 2) THEN s + l WHEN kind = 9 THEN greatest(s + l, sb + 100) ELSE s END AS "end", CASE WHEN kind = 9 THEN l + 100 ELSE l END AS length,
  CASE WHEN kind IN (3, 7, 8) OR (kind = 4 AND form = 0) THEN 'chrS' ELSE chrom END AS c2, CASE WHEN form = 1 THEN tr WHEN kind IN (3, 7, 8) THEN tr + 700 WHEN kind = 4 THEN tr + 1199 WHEN kind = 10 THEN ta + 1499 ELSE tb + 1 END AS s2, CASE WHEN kind IN (7, 8) THEN ta + 699 ELSE tr END AS e2 FROM cv),
k1 AS (SELECT *, kind BETWEEN 5 AND 8 AS dup FROM k0 WHERE CASE WHEN op = 'B' THEN support >= 5 WHEN sample = 'target' THEN support >= 5 AND length BETWEEN 50 AND 50000 ELSE length BETWEEN 30 AND 50000 END),
pa AS (SELECT sample, site, form, chrom, start AS at, support FROM k1 UNION ALL SELECT sample, site, form, chrom, sb, support FROM k1 WHERE kind = 9),
pd AS (SELECT p.sample, p.site, p.form, p.at, any_value(p.support) AS support, coalesce(max(s.depth), 0) AS depth FROM pa p LEFT JOIN seg s ON s.sample = p.sample AND s.chrom = p.chrom AND s.lo <= p.at + 4 AND s.hi >= p.at - 5 GROUP BY ALL),
pv AS (SELECT sample, site, form, CAST(floor(avg(depth)) AS bigint) AS depth, CAST(printf('%.2f', avg(CASE WHEN depth > 0 THEN CAST(printf('%.2f', least(1.0::double, support::double / depth)) AS double) ELSE 1.0 END)) AS double) AS vaf FROM pd GROUP BY ALL),
k2 AS (SELECT *, (length + 1) * 7 // 10 AS e, CASE WHEN kind IN (5, 6) THEN least(start, s2) WHEN kind IN (7, 8) THEN 0 ELSE start END AS lo2, CASE WHEN kind IN (5, 6) THEN greatest(start, e2) WHEN kind IN (7, 8) THEN 9999999 ELSE "end" END AS hi2 FROM k1 JOIN pv USING (sample, site, form)),
k3 AS (SELECT *, least(start - e, lo2) AS x1, greatest("end" + e, hi2) AS x2 FROM k2),
k4 AS (SELECT *, start - x1 AS fl, x2 - "end" AS fr FROM k3),
cr AS (SELECT *, CASE WHEN type LIKE '%+%' OR type IN ('itDUP', 'idDUP') THEN 'CSV' ELSE 'SV' END AS class, CASE WHEN vaf >= 0.8 THEN '1/1' WHEN vaf >= 0.2 THEN '0/1' ELSE '0/0' END AS gt,
  x1 - CASE WHEN fl > 0 AND fr / fl::double > 5 THEN CAST(round_even(fr / fl::double / 5, 0) * fl AS bigint) ELSE 0 END AS "left", x2 + CASE WHEN fr > 0 AND fl / fr::double > 5 THEN CAST(round_even(fl / fr::double / 5, 0) * fr AS bigint) ELSE 0 END AS "right",
  CASE WHEN kind = 9 THEN concat_ws('++', 'DEL', l, chrom, start, start + l, start) || ',' || concat_ws('++', 'INV', 100, chrom, sb, sb + 100, sb) WHEN dup THEN concat_ws('++', type, l, c2, s2, e2, start) ELSE concat_ws('++', type, l, chrom, start, "end", start) END AS bkps,
  CASE WHEN kind = 3 THEN concat('[chrS:', s2, '[N') WHEN op = 'B' THEN concat(']', c2, ':', s2, ']N') END AS alt FROM k4)"""


def _reads_sql() -> tuple[str, str, str]:
    """READS with the depth segments of its spans between."""
    head, _, tail = READS.partition("ce AS (")
    return head.rstrip().rstrip(","), SEG, "ce AS (" + tail


def reads_of_sites(spark, d):
    x = sig(spark, d).groupBy("sample", "chrom", "site", "ref_start", "length", "read_id").agg(F.max("mapq").alias("mapq"))
    kind = F.col("site") % 11
    x = x.withColumns({"kind": F.when((kind == 4) & (F.col("ref_start") % 2 == 1), 11).otherwise(kind), "r": F.col("ref_start"), "n": F.col("length")})

    def other(chrom, at, strand, cigar_):
        text = [t if isinstance(t, str) else t.cast("string") for t in cigar_]
        return F.concat_ws(",", F.lit("chrS") if chrom == "chrS" else F.col(chrom), at.cast("string"), F.lit(strand), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]), F.col("mapq").cast("string"), F.lit("0"))

    r, n = F.col("r"), F.col("n")
    behind = (n + 500, "S500M")
    # start, CIGAR, and the other alignments of a read of each kind
    shapes = {
        0: (r - 500, ("500M", n, "D500M"), []), 1: (r - 499, ("500M", n, "I500M"), []), 2: (r - 500, ("500M", n + 500, "S"), [("chrom", r, "-", ("500S", n, "M500S")), ("chrom", r + n, "+", behind)]),
        3: (r - 499, ("500M500S",), [("chrS", r + 700, "+", ("500S500M",))]), 4: (r - 499, ("500M500S",), [("chrS", r + 700, "-", ("500M500S",))]),
        5: (r - n - 499, (n + 500, "M", n + 500, "S"), [("chrom", r - n + 1, "+", (n + 500, "S", n + 500, "M"))]),
        6: (r - n - 499, (n + 500, "M", n + 500, "S"), [("chrom", r - n + 1, "-", ("500S", n, "M", n + 500, "S")), ("chrom", r + 1, "+", (n * 2 + 500, "S500M"))]),
        7: (r - 499, ("500M", n + 500, "S"), [("chrS", r + 700, "+", ("500S", n, "M500S")), ("chrom", r + 1, "+", behind)]),
        8: (r - 499, ("500M", n + 500, "S"), [("chrS", r + 700, "-", ("500S", n, "M500S")), ("chrom", r + 1, "+", behind)]),
        9: (r - 500, ("500M600S",), [("chrom", r + n, "-", ("500S100M500S",)), ("chrom", r + n + 100, "+", ("600S500M",))]),
        10: (r - 499, ("500M500S",), [("chrom", r + n + 1000, "-", ("500M500S",))]),
        11: (r + 700, ("500M500S",), [("chrom", r - 499, "-", ("500M500S",))]),
    }

    def chosen(of, end):
        out = F.lit(None)
        for k, shape in shapes.items():
            out = F.when(F.col("kind") == k, of(shape)).otherwise(out)
        return out.alias(end)

    joined = lambda cells: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in cells])
    x = x.select(
        "sample", F.concat_ws("/", F.col("read_id").cast("string"), F.col("site").cast("string")).alias("read_id"), F.lit(0).alias("flag"), F.when(F.col("kind") == 11, "chrS").otherwise(F.col("chrom")).alias("chrom"), "mapq",
        chosen(lambda s: s[0], "ref_start"), chosen(lambda s: joined(s[1]), "cigar"), chosen(lambda s: F.concat_ws(";", *[other(*o) for o in s[2]], F.lit("")) if s[2] else F.lit(None), "sa"),
    )
    return x.withColumn("ref_end", F.col("ref_start") + cigar.ref_span(cigar.tokens(F.col("cigar"))) - 1)


def called_reads(spark, d):
    x = kept(reads_of_sites(spark, d))
    return call_reads(x, x.select("chrom").distinct(), P)


@query(_sql(SIG, *_reads_sql(), select='SELECT sample, chrom, type, class, op, start, "end", length, support, depth, vaf, gt, \'PASS\' AS filter, "left", "right", bkps, alt FROM cr'))
def q_detect_reads(spark, d):
    return called_reads(spark, d).select("sample", "chrom", "type", "class", "op", "start", "end", "length", "support", "depth", "vaf", "gt", "filter", "left", "right", "bkps", "alt")


@query(_sql(SIG, *_reads_sql(), select='SELECT sample, chrom, type, start, "end", length, support, depth, vaf, gt, "left", "right", bkps FROM cr WHERE op <> \'B\'').replace("support >= 5", "support >= 1"))
def q_detect_assemblies(spark, d):
    x = kept(reads_of_sites(spark, d))
    got = call_reads(x, x.select("chrom").distinct(), replace(PRESETS["asm"], skip_bnd=True))
    return got.select("sample", "chrom", "type", "start", "end", "length", "support", "depth", "vaf", "gt", "left", "right", "bkps")


#: Of a step seen from either end the record on chrS goes; a turn along the chromosome is a large inversion.
RECORDS = """nm AS (SELECT sample, site, form, string_agg(DISTINCT read_id, ',' ORDER BY read_id) AS names FROM rd GROUP BY ALL),
tg AS (SELECT * FROM cr JOIN nm USING (sample, site, form) WHERE sample = 'target' AND NOT (form = 1 AND site IN (SELECT site FROM cr WHERE sample = 'target' AND kind = 4 AND form = 0))),
ls AS (SELECT tg.*, CASE WHEN b.site IS NULL THEN 'NewCOMP' WHEN b.vaf = 0 THEN 'NewCOMP' WHEN abs(tg.vaf - b.vaf) >= 0.3 THEN 'NewALLELE' ELSE 'Germline' END AS label, coalesce(b.vaf, 0.0) AS bv, b.depth AS bd, b.support AS bs FROM tg LEFT JOIN (SELECT * FROM cr WHERE sample = 'base') b ON b.site = tg.site AND b.form = tg.form),
rx AS (SELECT *, kind = 10 AS large, CASE WHEN kind = 10 THEN 1 WHEN op = 'B' THEN 2 ELSE 0 END AS rank, CASE WHEN kind = 10 THEN least(start, s2) WHEN kind IN (5, 6) THEN least(s2, e2, start) ELSE start END AS pos,
  CASE WHEN kind = 10 THEN greatest(start, s2) WHEN kind IN (5, 6) THEN greatest(s2, e2, start) ELSE "end" END AS stop, abs(start - s2) AS far FROM ls),
ry AS (SELECT *, row_number() OVER (ORDER BY rank, chrom, start, stop, site) - 1 AS number FROM rx)"""
LINE = """concat_ws(chr(9), chrom, pos, number, 'N', CASE WHEN large THEN 'SV' WHEN op = 'B' THEN alt ELSE class END, '.', 'PASS', concat_ws(';', 'END=' || stop, 'SVLEN=' || CASE WHEN large THEN far WHEN op = 'B' THEN NULL ELSE length END,
  'SVTYPE=' || CASE WHEN large THEN 'INV' ELSE type END, 'SUPPORT=' || support, 'VAF=' || vaf, 'BKPS=' || CASE WHEN large THEN concat_ws('_', 'INV', far, chrom, pos, stop, stop) WHEN op = 'B' THEN NULL ELSE replace(bkps, '++', '_') END,
  'BKPSIT=' || array_to_string(list_transform(string_split(type, '+'), lambda k: concat(k, '_', label)), ','), 'RNAMES=' || names), 'GT:DR:DV', concat_ws(':', gt, greatest(depth - support, 0), support),
  concat_ws(':', CASE WHEN label = 'Germline' THEN gt WHEN bv >= 0.8 THEN '1/1' WHEN bv >= 0.2 THEN '0/1' ELSE '0/0' END, CASE WHEN bs IS NULL THEN 'NA' ELSE CAST(greatest(bd - bs, 0) AS string) END, coalesce(CAST(bs AS string), 'NA')))"""


@query(_sql(SIG, *_reads_sql(), RECORDS, select=f"SELECT number, rank, chrom, pos, {LINE} AS line FROM ry"))
def q_records(spark, d):
    return records.record_lines(called_reads(spark, d), ["base"], P)


#: Two reads of three of a site see a deletion and an inversion, or as often an insertion, of which some know the source, and an inversion.
PARTSQL = """ev AS (SELECT concat(sample, '/', CAST(site AS string)) AS pid, chrom, ref_start AS s, length AS n, read_id, CASE WHEN read_id % 2 = 0 THEN 'D+V' WHEN read_id % 5 = 1 THEN 'I+V+D' ELSE 'I+V' END AS op, 1 + read_id % 3 AS w, read_id % 4 = 1 AS copy FROM sig),
pt AS (SELECT pid, op, w, 0 AS i, substr(op, 1, 1) AS pop, chrom, s, n, copy AND op <> 'D+V' AS copy, CASE WHEN copy AND op <> 'D+V' THEN 'chrS' END AS c2, CASE WHEN copy AND op <> 'D+V' THEN s + 9 END AS s2, CASE WHEN copy AND op <> 'D+V' THEN s + n + 8 END AS e2, CASE WHEN copy AND op <> 'D+V' THEN '-' END AS t2 FROM ev
  UNION ALL SELECT pid, op, w, 1, 'V', chrom, s + n, 100 + n % 3, false, NULL, NULL, NULL, NULL FROM ev UNION ALL SELECT pid, op, w, 2, 'D', chrom, s + n + 300, n, false, NULL, NULL, NULL, NULL FROM ev WHERE op = 'I+V+D'),
bo AS (SELECT pid, first(op ORDER BY n DESC, op) AS op FROM (SELECT pid, op, sum(w) AS n FROM pt WHERE i = 0 GROUP BY ALL) GROUP BY pid),
po AS (SELECT pt.* FROM pt JOIN bo USING (pid, op)),
pf AS (SELECT pid, i, any_value(pop) OVER (PARTITION BY pid, i) AS pop, w, unnest(['s', 'n', 's2', 'e2', 'copy', 'c2', 't2']) AS f, unnest([s, n, s2, e2, NULL, NULL, NULL]) AS num, unnest([NULL, NULL, NULL, NULL, CASE WHEN pop = 'I' THEN CASE WHEN copy THEN 'a copy' ELSE 'no' END END, c2, t2]) AS txt FROM po),
pn AS (SELECT pid, i, pop, f, num, txt, CAST(sum(w) AS bigint) AS n FROM pf WHERE num IS NOT NULL OR txt IS NOT NULL GROUP BY ALL),
pq AS (SELECT *, sum(n) OVER (PARTITION BY pid, i, f ORDER BY num, txt) AS upto, sum(n) OVER (PARTITION BY pid, i, f) AS every FROM pn),
px AS (SELECT pid, i, pop, f, first(num ORDER BY n DESC, num) AS top, max(n) AS most, first(txt ORDER BY n DESC, txt) AS txt, min(CASE WHEN upto > floor(every / 2) THEN num END) AS mid FROM pq GROUP BY ALL),
py AS (SELECT pid, i, pop, max(CASE WHEN f = 's' THEN CASE WHEN most >= 5 THEN top ELSE mid END END) AS s, max(CASE WHEN f = 'n' THEN CASE WHEN most >= 5 THEN top ELSE mid END END) AS n, max(CASE WHEN f = 's2' THEN top END) AS s2, max(CASE WHEN f = 'e2' THEN top END) AS e2,
  coalesce(max(CASE WHEN f = 'copy' THEN txt END) = 'a copy', false) AS copy, max(CASE WHEN f = 'c2' THEN txt END) AS c2, max(CASE WHEN f = 't2' THEN txt END) AS t2 FROM px GROUP BY ALL)"""


@query(_sql(SIG, PARTSQL, select='SELECT pid, CAST(i AS int) AS i, pop AS op, s AS start, CASE WHEN pop = \'I\' THEN s ELSE s + n END AS "end", n AS length, CASE WHEN copy THEN c2 END AS chrom2, CASE WHEN copy THEN s2 END AS start2, CASE WHEN copy THEN e2 END AS end2, CASE WHEN copy THEN t2 END AS strand2 FROM py'))
def q_consensus_parts(spark, d):
    r, s, n = F.col("read_id"), F.col("ref_start"), F.col("length")
    turned = events.part("V", F.col("chrom"), s + n, s + n + 100 + n % 3, 100 + n % 3)
    copy = events.part("I", F.col("chrom"), s, s, n, "+", (F.lit("chrS"), s + 9, s + n + 8, F.lit("-")))
    fresh = events.part("I", F.col("chrom"), s, s, n)
    gone = lambda at: events.part("D", F.col("chrom"), at, at + n, n)
    first = F.when(r % 4 == 1, copy).otherwise(fresh)
    parts = F.when(r % 2 == 0, F.array(gone(s), turned)).when(r % 5 == 1, F.array(first, turned, gone(s + n + 300))).otherwise(F.array(first, turned))
    op = F.when(r % 2 == 0, "D+V").when(r % 5 == 1, "I+V+D").otherwise("I+V")
    x = sig(spark, d).select(F.concat_ws("/", "sample", F.col("site").cast("string")).alias("pid"), op.alias("op"), parts.alias("parts"), (1 + r % 3).alias("support"))
    x = consensus.consensus_parts(x, P).select("pid", F.posexplode("parts").alias("i", "e"))
    return x.select("pid", "i", "e.op", F.col("e.ref_start").alias("start"), F.col("e.ref_end").alias("end"), "e.length", "e.chrom2", "e.start2", "e.end2", "e.strand2")


#: Each document as a chromosome, what is no letter or blank unknown.
CHROMS = "ch AS (SELECT CAST(doc_id AS string) AS chrom, regexp_replace(text, '[^A-Za-z ]', 'N', 'g') AS b, length(text) AS n, doc_id FROM documents WHERE length(text) > 0)"


def _chromosomes(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").where(F.length("text") > 0)
    return t.select(F.col("doc_id").cast("string").alias("chrom"), F.regexp_replace("text", "[^A-Za-z ]", "N").alias("bases"), F.length("text").alias("n"))


@query(_sql(CHROMS, select="SELECT chrom, k, md5(substr(b, CAST(greatest(1, lo) AS bigint), CAST(greatest(0, hi - greatest(1, lo) + 1) AS bigint))) AS bases FROM (SELECT *, unnest([0, 1, 2]) AS k, unnest([-20, n // 3, n - 5]) AS lo, unnest([30, n // 3 + 1500, n + 5]) AS hi FROM ch)"))
def q_fetch(spark, d):
    c, n = _chromosomes(spark, d), F.col("n").cast("long")
    third = F.floor(n / 3)
    spans = F.array(*[F.struct(F.lit(k).alias("k"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")) for k, (lo, hi) in enumerate(((F.lit(-20), F.lit(30)), (third, third + 1500), (n - 5, n + 5)))])
    ranges = c.select("chrom", F.explode(spans).alias("r")).select(F.concat_ws("|", "chrom", F.col("r.k").cast("string")).alias("id"), "chrom", "r.k", "r.lo", "r.hi")
    return reference.fetched(ranges, reference.chunks_of(c, 512), 512).select("chrom", "k", F.md5("bases").alias("bases"))


@query(_sql(CHROMS, select="SELECT chrom, 0 AS start, n AS \"end\" FROM ch WHERE doc_id IN (SELECT doc_id FROM labels)"))
def q_chrom_intervals(spark, d):
    seen = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").cast("string").alias("chrom"))
    return reference.whole_chromosomes(reference.chunks_of(_chromosomes(spark, d), 512), seen, 512)


@query(_sql(CHROMS, select="SELECT chrom, op, count(*) AS n, CAST(sum(pos) AS bigint) AS at FROM (SELECT chrom, unnest(string_split(substr(b, CAST(n // 4 + 1 AS bigint), CAST(n // 4 + 1 AS bigint)), '')) AS op, n // 4 + 1 + unnest(range(CAST(n // 4 + 1 AS bigint))) AS pos FROM ch) WHERE op <> '' AND op <> ' ' GROUP BY ALL"))
def q_ref_map(spark, d):
    c = _chromosomes(spark, d)
    quarter = F.floor(F.col("n") / 4)
    ranges = c.select(F.col("chrom").alias("id"), "chrom", (quarter + 1).alias("lo"), (2 * quarter + 1).alias("hi"))
    runs = positions.reference_map(ranges, reference.chunks_of(c, 512), 512)
    n = F.col("hi") - F.col("lo") + 1
    return runs.where("op <> ' ' and pct = 100").groupBy("chrom", "op").agg(F.sum(n).alias("n"), F.sum(n * (F.col("lo") + F.col("hi")) / 2).cast("long").alias("at"))


@query("""WITH b AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', 'N', 'g') AS b, length(text) // 2 AS pos FROM documents WHERE length(text) > 0)
SELECT doc_id FROM b WHERE NOT contains(substring(b, CAST(greatest(1, pos - 999) AS bigint), CAST(pos + 1000 - greatest(0, pos - 1000) AS bigint)), 'NNNNN') AND NOT contains(substring(b, CAST(pos AS bigint), CASE WHEN pos = 0 THEN 1199 ELSE 1200 END), 'NNNNN')""")
def q_n_windows(spark, d):
    c = _chromosomes(spark, d)
    at = F.floor(F.col("n") / 2)
    gone = events.part("D", F.col("chrom"), at, at + 1199, 1199)
    calls_ = c.select(F.col("chrom").alias("pid"), "chrom", F.lit("D").alias("op"), at.alias("ref_start"), F.array(gone).alias("parts"))
    return reference.without_unknown(calls_, reference.chunks_of(c), P).select(F.col("pid").cast("long").alias("doc_id"))


@query(_sql(SIG, SPAN, SEG, "wn AS (SELECT sample, chrom, ref_start // 5000 AS win, op, count(DISTINCT read_id) AS reads FROM sig GROUP BY ALL)", select="SELECT sample, chrom, win, first(op ORDER BY reads DESC, CASE op WHEN 'I' THEN 1 WHEN 'D' THEN 2 ELSE 3 END) AS op, max(reads) AS reads FROM wn GROUP BY ALL"))
def q_top_op(spark, d):
    n = sig(spark, d).groupBy("sample", "chrom", F.floor(F.col("ref_start") / 5000).alias("win"), "op").agg(F.countDistinct("read_id").alias("reads"))
    first = F.when(F.col("op") == "I", -1).when(F.col("op") == "D", -2).otherwise(-3)
    return n.groupBy("sample", "chrom", "win").agg(F.max_by("op", F.struct(F.col("reads"), first)).alias("op"), F.max("reads").alias("reads"))


AL = f"""{AE}, al AS (SELECT aln_id, read_id, chrom, ref_start, ref_end, ref_start % 4000 AS read_start, ref_start % 4000 + m1 + m2 + CASE WHEN op = 'I' THEN n ELSE 0 END - 1 AS read_end,
  CASE WHEN ref_start % 2 = 0 THEN '+' ELSE '-' END AS strand, row_number() OVER (PARTITION BY read_id ORDER BY aln_id) = 1 AS is_primary, CAST(5200 AS bigint) AS read_length FROM a)"""
ALONG = "ORDER BY read_start + read_end, read_start, read_end, chrom, ref_start, aln_id"


def _split_reads(spark, d):
    x, first = aln(spark, d), Window.partitionBy("read_id").orderBy("aln_id")
    start = F.col("ref_start") % 4000
    return x.select(
        "aln_id", "read_id", "chrom", "ref_start", "ref_end", start.alias("read_start"), (start + cigar.read_span(cigar.tokens(F.col("cigar"))) - 1).alias("read_end"),
        F.when(F.col("ref_start") % 2 == 0, "+").otherwise("-").alias("strand"), (F.row_number().over(first) == 1).alias("is_primary"), F.lit(5200).cast("long").alias("read_length"),
    )


@query(_sql(AL, f"x AS (SELECT *, lag(read_end) OVER w AS le, lead(read_start) OVER w AS ns, lead(is_primary) OVER w AS np FROM al WINDOW w AS (PARTITION BY read_id {ALONG}))", select="SELECT read_id, aln_id FROM x WHERE is_primary OR NOT (coalesce(le - read_start > 500, false) OR coalesce(np AND read_end - ns > 500, false))"))
def q_read_overlap_drop(spark, d):
    return reads.without_overlapping(_split_reads(spark, d)).select("read_id", "aln_id")


GAP = f"""x AS (SELECT *, lag(aln_id) OVER w AS bf, lead(read_start) OVER w AS ns, max(CASE WHEN is_primary THEN chrom END) OVER (PARTITION BY read_id) AS own,
  lead(ref_start) OVER (PARTITION BY read_id, chrom {ALONG}) AS nr FROM al WINDOW w AS (PARTITION BY read_id {ALONG})),
gp AS (SELECT read_id, 'I' AS op, chrom, ref_start, ref_start AS ref_end, CAST(0 AS bigint) AS read_start, read_start - 1 AS read_end, read_start AS length FROM x WHERE bf IS NULL AND read_start > 50
UNION ALL SELECT read_id, 'I', chrom, ref_end, ref_end, read_end + 1, read_length, read_length - read_end FROM x WHERE ns IS NULL AND read_length - read_end > 50
UNION ALL SELECT read_id, 'I', own, ref_end, ref_end, read_end + 1, ns - 1, ns - read_end - 1 FROM x WHERE ns - read_end - 1 > 50
UNION ALL SELECT read_id, 'D', chrom, ref_end + 1, nr - 1, read_end, read_end, nr - ref_end - 1 FROM x WHERE nr - ref_end - 1 > 50)"""


@query(_sql(AL, GAP, select="SELECT * FROM gp"))
def q_boost_aligns(spark, d):
    return reads.gap_events(_split_reads(spark, d), P)


@query(_sql(AL, f"""x AS (SELECT read_id, aln_id, chrom, CASE WHEN strand = '+' THEN ref_end ELSE ref_start END AS pos, lead(chrom) OVER w AS chrom2,
  CASE WHEN lead(strand) OVER w = '+' THEN lead(ref_start) OVER w ELSE lead(ref_end) OVER w END AS pos2, lead(strand) OVER w AS strand, CAST(50 AS bigint) AS length FROM al WINDOW w AS (PARTITION BY read_id {ALONG}))""", select="SELECT * FROM x WHERE chrom2 IS NOT NULL AND pos <> pos2 AND (chrom <> chrom2 OR abs(pos - pos2) > 50000)"))
def q_bnd_from_pair(spark, d):
    return reads.breakend_pairs(_split_reads(spark, d), P)


@query(_sql(AL, f"""x AS (SELECT *, first_value(chrom) OVER w AS fc, first_value(strand) OVER w AS fs, max(CASE WHEN is_primary THEN chrom END) OVER (PARTITION BY read_id) AS own FROM al
  WINDOW w AS (PARTITION BY read_id {ALONG})), y AS (SELECT *, fc <> own AND fs = '-' AS turn FROM x)""", select="""SELECT read_id, aln_id, CASE WHEN turn THEN greatest(0, read_length - read_end) ELSE read_start END AS read_start,
  CASE WHEN turn THEN least(read_length, read_length - read_start) ELSE read_end END AS read_end, CASE WHEN turn = (strand = '-') THEN '+' ELSE '-' END AS strand FROM y"""))
def q_read_turns(spark, d):
    return reads.facing_primary(_split_reads(spark, d)).select("read_id", "aln_id", "read_start", "read_end", "strand")


#: Forward alignments are anchors, reverse ones inversions; gaps are insertions and deletions.
PARTS = """pt AS (SELECT read_id, CASE WHEN strand = '+' THEN 'M' ELSE 'V' END AS op, chrom, ref_start, ref_end, read_start, read_end, ref_end - ref_start + 1 AS length FROM al
  UNION ALL SELECT read_id, op, chrom, ref_start, ref_end, read_start, read_end, length FROM gp),
pk AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY read_start + read_end, read_start, read_end, chrom, ref_start, op, length) AS k FROM pt),
pw AS (SELECT *, count(*) FILTER (op = 'M') OVER (PARTITION BY read_id, chrom ORDER BY k) AS bf, count(*) FILTER (op = 'M') OVER (PARTITION BY read_id, chrom) AS al,
  count(*) FILTER (op <> 'I') OVER (PARTITION BY read_id ORDER BY k) AS hd, count(*) FILTER (op <> 'I') OVER (PARTITION BY read_id ORDER BY k DESC) AS tl, op <> 'I' AND ref_end - ref_start > 50000 AS far FROM pk),
pe AS (SELECT read_id, chrom, concat(chrom, ':', CAST(bf AS string)) AS g, k, CASE WHEN far THEN 'B' ELSE op END AS op, ref_start, CASE WHEN far THEN ref_start ELSE ref_end END AS ref_end, CASE WHEN far THEN 1 ELSE length END AS length
  FROM pw WHERE op <> 'M' AND bf BETWEEN 1 AND al - 1 AND length >= 50
  UNION ALL SELECT read_id, chrom, '<', k, op, ref_start, ref_end, length FROM pw WHERE hd = 0 UNION ALL SELECT read_id, chrom, '>', -k, op, ref_start, ref_end, length FROM pw WHERE tl = 0)"""


def _anchored(spark, d):
    """Split reads with the op of each alignment, and those with gaps as parts."""
    a = _split_reads(spark, d).withColumn("op", F.when(F.col("strand") == "+", "M").otherwise("V"))
    names = ["read_id", "op", "chrom", "ref_start", "ref_end", "read_start", "read_end", "length"]
    return a, a.withColumn("length", F.col("ref_end") - F.col("ref_start") + 1).select(*names).unionByName(reads.gap_events(a, P).select(*names))


@query(_sql(AL, GAP, PARTS, select="SELECT read_id, first(chrom ORDER BY k) AS chrom, string_agg(op, '+' ORDER BY k) AS op, count(*) AS n_parts, min(ref_start) AS ref_start, max(ref_end) AS ref_end, CAST(sum(length) AS bigint) AS length, g IN ('<', '>') AS uncovered FROM pe GROUP BY read_id, g"))
def q_inter_signatures(spark, d):
    return reads.between_anchors(_anchored(spark, d)[1], P).drop("parts")


@query(_sql(AL, f"""x AS (SELECT read_id, aln_id, chrom, CASE WHEN strand = '+' THEN ref_end ELSE ref_start END AS pos, lead(chrom) OVER w AS chrom2, CASE WHEN lead(strand) OVER w = '+' THEN lead(ref_start) OVER w ELSE lead(ref_end) OVER w END AS pos2,
  lead(strand) OVER w AS strand, CAST(50 AS bigint) AS length, row_number() OVER w AS k, min(CASE WHEN strand = '+' THEN 0 ELSE 1 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bare, min(CASE WHEN strand = '+' THEN 0 ELSE 1 END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rest
  FROM al WINDOW w AS (PARTITION BY read_id, chrom {ALONG}))""", select="SELECT read_id, aln_id, chrom, pos, chrom2, pos2, strand, length FROM x WHERE chrom2 IS NOT NULL AND pos <> pos2 AND (bare = 1 OR rest = 1)"))
def q_unanchored_bnds(spark, d):
    return reads.unanchored_breakends(_anchored(spark, d)[0], P)


def _near(spark, d):
    """Split reads on a short reference, so that their alignments overlap."""
    start = F.col("ref_start") % 2000
    return _split_reads(spark, d).withColumns({"ref_start": start, "ref_end": start + F.col("ref_end") - F.col("ref_start")})


@query(_sql(AL, f"""x AS (SELECT *, first_value(chrom) OVER w AS home, CASE WHEN strand = '+' THEN 'M' ELSE 'V' END AS op FROM al WINDOW w AS (PARTITION BY read_id {ALONG})),
y AS (SELECT *, chrom = home AS own, row_number() OVER (PARTITION BY read_id {ALONG}) AS k FROM x),
z AS (SELECT *, max(CASE WHEN own THEN k END) OVER (PARTITION BY read_id ORDER BY k) AS at, max(CASE WHEN own THEN k END) OVER (PARTITION BY read_id) AS top FROM y),
m AS (SELECT z.*, NOT z.own AND z.k < z.top AS moved, a.ref_end AS e, a.strand AS s FROM z JOIN y a ON a.read_id = z.read_id AND a.k = z.at)""", select="""SELECT read_id, aln_id, CASE WHEN moved THEN 'I' ELSE op END AS op, CASE WHEN moved THEN home ELSE chrom END AS chrom, CASE WHEN moved THEN e ELSE ref_start END AS ref_start,
  CASE WHEN moved THEN e ELSE ref_end END AS ref_end, CASE WHEN moved THEN s ELSE strand END AS strand, CASE WHEN moved THEN chrom END AS src_chrom, CASE WHEN moved THEN ref_start END AS src_start FROM m"""))
def q_foreign_stretches(spark, d):
    none = {f"src_{n}": F.lit(None).cast(t) for n, t in (("chrom", "string"), ("start", "long"), ("end", "long"), ("strand", "string"))}
    out = reads.foreign_stretches(_anchored(spark, d)[0].withColumns(none))
    return out.select("read_id", "aln_id", "op", "chrom", "ref_start", "ref_end", "strand", "src_chrom", "src_start")


# a fold that cuts as it goes has no SQL form; the tests hold it against written cases
@query()
def q_resolve_on_ref(spark, d):
    return reads.resolve_on_reference(_near(spark, d))


@query()
def q_split_read_events(spark, d):
    return split_read_events(_near(spark, d), P).drop("parts")


@query(_sql(SIG, SRC, """g AS (SELECT read_id, first(ref_start ORDER BY ref_start, chrom) AS st, first(chrom ORDER BY ref_start, chrom) AS ch, count(*) AS n, bool_and(op = 'I') AS ins, CAST(sum(length) AS bigint) AS total FROM src GROUP BY read_id),
f AS (SELECT read_id, any_value(n) AS n, any_value(total) AS length, any_value(ins) AND (any_value(n) > 4 OR bool_or(coalesce(c2 = ch AND abs(s2 - st) > 50000, false))) AS merged FROM src x JOIN (SELECT read_id AS r, * EXCLUDE (read_id) FROM g) ON read_id = r GROUP BY read_id)""", select="SELECT read_id, merged, CAST(CASE WHEN merged THEN 1 ELSE n END AS int) AS parts, length FROM f"))
def q_merge_split_ins(spark, d):
    return reads.merge_split_insertions(_with_source(spark, d).withColumnsRenamed({"c2": "src_chrom", "s2": "src_start"}), P)


@query(_sql(SIG, "rd AS (SELECT read_id, list(op ORDER BY ref_start, op, length) AS l FROM sig GROUP BY read_id)", "s AS (SELECT read_id % 500 AS cluster, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '+') AS op, count(*) AS support FROM rd GROUP BY ALL)", select="SELECT cluster, op, support, CASE WHEN support >= 5 AND row_number() OVER (PARTITION BY cluster ORDER BY support DESC, op) = 1 THEN cluster % 4 ELSE 0 END AS bonus FROM s"))
def q_fine_split(spark, d):
    e = q_hyper_props(spark, d).select((F.col("read_id") % 500).alias("cluster"), "op", "read_id")
    return rescue.fine_split(e, ["cluster"], e.select("cluster").distinct().withColumn("bonus", F.col("cluster") % 4), P)


LOOSE = "loose AS (SELECT DISTINCT concat_ws('-', chrom, op, CAST(ref_start AS string), CAST(length AS string)) AS id, chrom, op, ref_start, length FROM sig WHERE sample = 'base')"


def _loose(spark, d):
    s = sig(spark, d).where("sample = 'base'").select("chrom", "op", "ref_start", "length").distinct()
    return s.withColumn("id", F.concat_ws("-", "chrom", "op", F.col("ref_start").cast("string"), F.col("length").cast("string")))


def _target(spark, d):
    return calls(spark, d).where("sample = 'target'").withColumnRenamed("site", "call_id")


def _first(fits: str, reads_: str = "loose") -> str:
    return f"SELECT id, arg_min(site, struct_pack(k := -support, s := site)) AS call_id FROM {reads_} x JOIN (SELECT chrom AS c, op AS o, start, length AS n, support, site FROM calls WHERE sample = 'target') ON chrom = c WHERE {fits} GROUP BY id"


@query(_sql(SIG, OK, SITE, LOOSE, select=_first("op = o AND abs(length - n) < 20 AND ((op = 'I' AND abs(ref_start - start) < 20) OR (op = 'D' AND abs(ref_start - start) < 50))")))
def q_rescue_short(spark, d):
    return rescue.rescue_short(_loose(spark, d), _target(spark, d), P)


@query(_sql(SIG, OK, SITE, LOOSE, select=_first("o = 'I' AND op <> 'D' AND abs(ref_start - start) <= 1000")))
def q_rescue_uncovered(spark, d):
    return rescue.rescue_uncovered(_loose(spark, d), _target(spark, d), P)


@query(_sql(SIG, OK, SITE, BNDS, "ins AS (SELECT chrom AS c, site, start + 30 AS start, support FROM calls WHERE sample = 'target' AND op = 'V')", "hit AS (SELECT id, arg_min(site, struct_pack(k := -support, s := site)) AS call_id FROM bn JOIN ins ON (c = chrom AND abs(start - pos) < 50) OR (c = chrom2 AND abs(start - pos2) < 50) GROUP BY id)", select="SELECT bn.id, call_id FROM bn LEFT JOIN hit ON bn.id = hit.id"))
def q_bnd_absorb(spark, d):
    b = _bnds(spark, d)
    ins = _target(spark, d).where("op = 'V'").withColumn("start", F.col("start") + 30)
    return b.select("id").join(rescue.absorbed_breakends(b, ins), "id", "left")


@query("""WITH b AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', 'N', 'g') AS b, length(text) // 2 AS pos FROM documents)
SELECT doc_id FROM b WHERE NOT coalesce(contains(substring(b, CAST(greatest(1, pos - 999) AS bigint), 2000), 'NNNNN'), false) AND NOT coalesce(contains(substring(b, pos + 1, 30), 'NNNNN'), false)""")
def q_n_filter(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.regexp_replace("text", "[^A-Za-z ]", "N").alias("b"), F.floor(F.length("text") / 2).cast("int").alias("pos"))
    t = t.select("doc_id", F.substring("b", F.greatest(F.lit(1), F.col("pos") - 999), F.lit(2000)).alias("bases"), F.substring("b", F.col("pos") + 1, F.lit(30)).alias("event"))
    return rescue.without_unknown_bases(t).select("doc_id")


SEG_OP = "span_o AS (SELECT concat(sample, '/', op) AS sample, chrom, read_id, ref_start AS lo, ref_start + length AS hi FROM sig),\n" + re.sub(r"\b(un0|un1|un|ed|seg|span)\b", r"\1_o", SEG)


#: Sites are 5000 apart, so runs that overlap are in one window of 5000 from 1000 before a site.
@query(_sql(SIG, SPAN, SEG, SEG_OP, "o AS (SELECT split_part(sample, '/', 1) AS sample, split_part(sample, '/', 2) AS op, chrom, lo, hi, depth AS n_reads FROM seg_o)", select="SELECT o.sample, o.chrom, o.op, greatest(o.lo, s.lo) AS lo, least(o.hi, s.hi) AS hi, n_reads, depth, CAST(least(100, round_even(100.0::double * n_reads / depth, 0)) AS int) AS pct FROM o JOIN seg s ON s.sample = o.sample AND s.chrom = o.chrom AND (o.lo + 1000) // 5000 = (s.lo + 1000) // 5000 AND o.lo <= s.hi AND s.lo <= o.hi"))
def q_pos_freq(spark, d):
    e = sig(spark, d).select("sample", "chrom", "read_id", "op", F.col("ref_start").alias("lo"), (F.col("ref_start") + F.col("length")).alias("hi"))
    return positions.frequencies(e, spans(spark, d))


#: A fifth of the parts begin near the window's edge; insertions have their source 1500 further on, the longest beyond the window; a seventh has no coverage.
MAP_PARTS = """mp AS (SELECT concat(sample, '/', CAST(site AS string)) AS id, sample, site, read_id, op, ref_start - CASE WHEN read_id % 5 = 0 THEN 520 ELSE 0 END AS lo,
    ref_start - CASE WHEN read_id % 5 = 0 THEN 520 ELSE 0 END + CASE WHEN op = 'I' THEN 0 ELSE length END AS hi, read_id AS nth, read_id % 7 AS coverage,
    CASE WHEN op = 'I' THEN ref_start + 1500 END AS src_lo, CASE WHEN op = 'I' THEN ref_start + 1500 + length END AS src_hi FROM sig)"""


@query(_sql(SIG, MAP_PARTS, """mw AS (SELECT *, site * 5000 + 9500 AS wlo, site * 5000 + 12500 AS whi FROM mp)""",
    """mk AS (SELECT id, read_id, op, lo, hi FROM mw WHERE lo >= wlo AND hi <= whi UNION ALL
      SELECT id, read_id, op, greatest(src_lo, wlo), least(src_hi, whi) FROM mw WHERE lo >= wlo AND hi <= whi AND sample = 'base' AND src_lo <= whi AND src_hi >= wlo)""",
    """cv AS (SELECT id, nth, 0 AS source, coverage, greatest(lo, wlo) AS lo, least(hi, whi) AS hi FROM mw WHERE sample = 'target' OR (lo >= wlo AND hi <= whi) UNION ALL
      SELECT id, nth, 1, coverage, src_lo, src_hi FROM mw WHERE sample = 'base' AND lo >= wlo AND hi <= whi AND src_lo >= wlo AND src_hi <= whi)""",
    """pt AS (SELECT id, lo AS p FROM mk UNION SELECT id, hi + 1 FROM mk UNION SELECT id, lo FROM cv WHERE lo <= hi UNION SELECT id, hi + 1 FROM cv WHERE lo <= hi)""",
    "st AS (SELECT id, p AS lo, lead(p) OVER (PARTITION BY id ORDER BY p) - 1 AS hi FROM pt)",
    "nr AS (SELECT st.id, st.lo, st.hi, op, count(DISTINCT read_id) AS n_reads FROM st JOIN mk ON mk.id = st.id AND mk.lo <= st.lo AND mk.hi >= st.hi GROUP BY ALL)",
    "dp AS (SELECT st.id, st.lo, arg_max(coverage, nth * 2 + source) AS coverage FROM st JOIN cv ON cv.id = st.id AND cv.lo <= st.lo AND cv.hi >= st.hi GROUP BY ALL)",
    "al AS (SELECT nr.*, coalesce(coverage, 1) AS coverage, sum(n_reads) OVER (PARTITION BY nr.id, nr.lo) AS every FROM nr LEFT JOIN dp USING (id, lo))",
    select="SELECT id, op, n_reads, CAST(coverage AS bigint) AS coverage, CAST(least(100, round_even(100.0::double * n_reads / CASE WHEN coverage = 0 THEN every ELSE coverage END, 0)) AS int) AS pct, CAST(sum(hi - lo + 1) AS bigint) AS n, CAST(sum((hi - lo + 1) * (lo + hi) / 2) AS bigint) AS at FROM al GROUP BY ALL"))
def q_pos_map(spark, d):
    parts = _view(spark, d, f"{SIG}, {MAP_PARTS}", "mp")
    windows = parts.select("id", (F.col("site") * 5000 + 9500).alias("lo"), (F.col("site") * 5000 + 12500).alias("hi"), (F.col("sample") == "base").alias("base")).distinct()
    m = positions.window_maps(windows, parts.drop("sample", "site"))
    n = F.col("hi") - F.col("lo") + 1
    return m.groupBy("id", "op", "n_reads", "coverage", "pct").agg(F.sum(n).alias("n"), F.sum(n * (F.col("lo") + F.col("hi")) / 2).cast("long").alias("at"))


@query(_sql(SIG, "r0 AS (SELECT *, CASE WHEN lag(op) OVER w = op THEN 0 ELSE 1 END AS fresh FROM sig WINDOW w AS (PARTITION BY read_id ORDER BY ref_start, op, length))", "r1 AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY read_id ORDER BY ref_start, op, length) AS bigint) AS run FROM r0)", select="SELECT read_id, run, op, count(*) AS n FROM r1 GROUP BY ALL"))
def q_pixel_runs(spark, d):
    return positions.class_runs(sig(spark, d), ["read_id"], ["ref_start", "op", "length"], "op")


PIXEL = """px AS (SELECT site, read_id, CASE WHEN read_id % 4 < 2 THEN 'BG' WHEN read_id % 4 = 2 THEN 'REF' WHEN read_id % 3 = 0 THEN 'INV' ELSE 'DEL' END AS class FROM sig),
p0 AS (SELECT *, CASE WHEN lag(class) OVER (PARTITION BY site ORDER BY read_id) = class THEN 0 ELSE 1 END AS fresh FROM px),
p1 AS (SELECT *, sum(fresh) OVER (PARTITION BY site ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT site, read_id, class, max(fresh) AS fresh, count(*) AS m FROM p0 GROUP BY ALL)),
p2 AS (SELECT site, run, class, sum(m) AS n FROM p1 GROUP BY ALL),
p3 AS (SELECT *, first(class) OVER (PARTITION BY site ORDER BY run) AS c1, first(class) OVER (PARTITION BY site ORDER BY run DESC) AS c2, count(*) FILTER (class = 'BG') OVER (PARTITION BY site ORDER BY run) AS allele FROM p2),
p4 AS (SELECT *, sum(n) OVER (PARTITION BY site, allele) AS pixels FROM p3 WHERE c1 = 'BG' AND c2 = 'BG' AND class <> 'BG'),
p5 AS (SELECT *, CAST(round(100 * CAST(printf('%.2f', n::double / pixels) AS double)) AS bigint) AS share FROM p4)"""


@query(_sql(SIG, PIXEL, select="SELECT site, allele, CASE WHEN allele % 2 = 1 THEN 'base' ELSE 'target' END AS source, CAST(any_value(pixels) AS bigint) AS pixels, coalesce(sum(share) FILTER (class = 'REF'), 0) / 100::double AS ref_vaf, coalesce(sum(share) FILTER (class <> 'REF'), 0) / 100::double AS alt_vaf, coalesce(last(class ORDER BY run) FILTER (class <> 'REF'), 'NA') AS alt_class FROM p5 GROUP BY site, allele"))
def q_pixel_alleles(spark, d):
    r = F.col("read_id")
    kind = F.when(r % 4 < 2, "BG").when(r % 4 == 2, "REF").when(r % 3 == 0, "INV").otherwise("DEL")
    px = sig(spark, d).select("site", "read_id", kind.alias("class"))
    return positions.pixel_alleles(positions.class_runs(px, ["site"], ["read_id"], "class"), ["site"], "class")


#: Lines of pixels by read, the last of which only closes a run; those with an insertion (I) run along the read.
LINES_OF = ("BBRRDBRDDDBB", "BRRRBDDDDBBV", "BRDDBRDDBBBD", "BRRRDBVVVVBB", "RRDDBRDDBBBB", "BDDBRRDDBRDB", "BBBIIIBBBBBB", "BRRRIIIIBBBB", "BBIIRBRIIIBB", "BRDVBRDDBIBB")
CLASS_OF = {"B": "BG", "R": "REF", "I": "INS", "D": "DEL", "V": "INV"}
ALLELES = f"""li AS (SELECT sample, site, read_id, [{', '.join(f"'{x}'" for x in LINES_OF)}][(read_id % 97 + site) % {len(LINES_OF)} + 1] AS line FROM (SELECT DISTINCT sample, site, read_id FROM sig)),
px AS (SELECT sample, site, read_id, CASE WHEN contains(line, 'III') THEN 'INS' ELSE 'DEL' END AS kind, x, CASE substr(line, CASE WHEN x = 12 THEN 11 ELSE x END, 1) WHEN 'B' THEN 'BG' WHEN 'R' THEN 'REF' WHEN 'I' THEN 'INS' WHEN 'D' THEN 'DEL' ELSE 'INV' END AS c FROM (SELECT *, CAST(unnest(range(1, 13)) AS int) AS x FROM li)),
r0 AS (SELECT *, CASE WHEN lag(c) OVER w = c THEN 0 ELSE 1 END AS fresh FROM px WINDOW w AS (PARTITION BY sample, site, read_id ORDER BY x)),
r1 AS (SELECT *, sum(fresh) OVER (PARTITION BY sample, site, read_id ORDER BY x) AS run FROM r0),
r2 AS (SELECT sample, site, read_id, kind, run, c, count(*) AS n FROM r1 GROUP BY ALL HAVING CASE WHEN kind = 'INS' THEN c IN ('INS', 'BG', 'REF') ELSE c <> 'INS' END),
r3 AS (SELECT sample, site, read_id, kind, list({{'c': c, 'n': n}} ORDER BY run) AS l FROM r2 GROUP BY ALL),
r4 AS (SELECT sample, site, read_id, kind, CASE WHEN kind = 'INS' AND ((len(l) = 3 AND l[2].c = 'INS') OR (len(l) = 4 AND l[3].c = 'INS')) THEN list_concat([{{'c': l[1].c, 'n': l[1].n - l[2].n - 1}}, {{'c': 'REF', 'n': l[2].n}}, {{'c': 'BG', 'n': 2}}], l[2:]) ELSE l END AS l FROM r3),
r5 AS (SELECT sample, site, read_id, kind, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS e, l[1].c = 'BG' AND l[len(l)].c = 'BG' AS edges FROM r4),
a0 AS (SELECT sample, site, read_id, kind, k, e.c AS c, e.n AS n, edges, count(*) FILTER (e.c = 'BG') OVER (PARTITION BY sample, site, read_id ORDER BY k) AS allele FROM r5),
a1 AS (SELECT *, CAST(round(100 * CAST(printf('%.2f', n::double / sum(n) OVER (PARTITION BY sample, site, read_id, allele)) AS double)) AS bigint) AS share FROM a0 WHERE edges AND c <> 'BG'),
a2 AS (SELECT sample, site, read_id, kind, allele, coalesce(sum(share) FILTER (c <> 'REF'), 0) / 100::double AS alt, coalesce(last(c ORDER BY k) FILTER (c <> 'REF'), 'NA') AS class FROM a1 GROUP BY ALL),
a3 AS (SELECT sample, site, read_id, kind, count(*) AS n, max(CASE WHEN allele = 1 THEN alt END) AS bv, max(CASE WHEN allele = 1 THEN class END) AS bc, max(CASE WHEN allele = 2 THEN alt END) AS tv, max(CASE WHEN allele = 2 THEN class END) AS tc FROM a2 GROUP BY ALL),
lb AS (SELECT *, CASE WHEN bv = 0 OR bc <> tc THEN 'NewCOMP' WHEN abs(bv - tv) >= 0.3 THEN 'NewALLELE' ELSE 'Germline' END AS label, CASE WHEN tv >= 0.3 AND (bv = 0 OR bc <> tc) THEN 'NewCOMP' WHEN bc = tc AND abs(bv - tv) >= 0.3 THEN 'NewALLELE' ELSE 'Germline' END AS somatic FROM a3 WHERE n % 2 = 0 AND tc = kind),
lr AS (SELECT sample, site, kind, list(label ORDER BY read_id) AS l, count(*) AS n, count(*) FILTER (somatic = 'NewCOMP') AS somatic FROM lb GROUP BY ALL),
ls AS (SELECT *, list_filter(l, lambda v, i: i = 1 OR l[i - 1] <> v) AS r FROM lr)"""


@query(_sql(SIG, ALLELES, select="""SELECT sample, site, kind, n, somatic, CASE WHEN len(r) = 1 THEN r[1] WHEN len(list_filter(l, lambda v: v = 'Germline')) / n::double >= 0.2 THEN 'Germline' WHEN len(list_filter(l, lambda v: v = 'NewALLELE')) / n::double >= 0.2 THEN 'NewALLELE' ELSE 'NewCOMP' END AS label,
  CASE WHEN len(r) = 1 THEN r[1] WHEN (r[1] = 'NewCOMP' AND r[2] = 'Germline') OR (r[len(r)] = 'NewCOMP' AND r[len(r) - 1] = 'Germline') THEN 'NewBKP' END AS breakpoint FROM ls"""))
def q_allele_labels(spark, d):
    x = sig(spark, d).select("sample", "site", "read_id").distinct()
    line = F.element_at(F.array(*[F.lit(t) for t in LINES_OF]), ((F.col("read_id") % 97 + F.col("site")) % len(LINES_OF) + 1).cast("int"))
    x = x.withColumn("line", line).withColumn("kind", F.when(F.col("line").contains("III"), "INS").otherwise("DEL"))
    keys = ["sample", "site", "read_id", "kind"]
    px = x.select(*keys, F.posexplode(F.split("line", "")).alias("x", "c")).where("c <> ''")
    px = px.withColumn("class", F.create_map(*[F.lit(v) for kv in CLASS_OF.items() for v in kv])[F.col("c")])
    along = F.when(F.col("kind") == "INS", F.col("class").isin("INS", "BG", "REF")).otherwise(F.col("class") != "INS")
    runs = positions.line_runs(px, keys, "x", "class", along)
    rows = positions.repaired_insertions(runs.where("kind = 'INS'"), keys, "class").unionByName(runs.where("kind <> 'INS'").select(*keys, "run", "class", "n"))
    pair = positions.allele_pairs(positions.pixel_alleles(rows, keys, "class"), keys, "kind")
    both = [C.allele_inheritance(F.col("base_vaf"), F.col("base_class"), F.col("target_vaf"), F.col("target_class"), P.diff_freq, somatic) for somatic in (False, True)]
    # three groupings read them
    lines = kept(pair.select(*keys, both[0].alias("label"), both[1].alias("somatic")))
    own = ["sample", "site", "kind"]
    count = lines.groupBy(*own).agg(F.count(ONE).alias("n"), F.count_if(F.col("somatic") == "NewCOMP").alias("somatic"))
    ends = compare.new_breakpoint_label(lines, own, "read_id").withColumnRenamed("label", "breakpoint")
    return count.join(compare.final_label(lines, own), own).join(ends, own)


@query(_sql(SIG, OK, SITE, select="SELECT sample, site, greatest(f + CASE WHEN op IN ('D', 'V') THEN length ELSE 0 END, f + CASE WHEN op IN ('I', 'V') THEN length ELSE 0 END) / 256.0::double AS ratio FROM (SELECT *, 2 * ((length + 1) * 7 // 10) AS f FROM calls)"))
def q_img_ratio(spark, d):
    return positions.image_ratio(cluster.extended(calls(spark, d))).select("sample", "site", "ratio")


DIST = "least(abs(start - start2), abs(start + length - start2 - length2), abs((2 * start + length) // 2 - (2 * start2 + length2) // 2)) / length::double + abs(length - length2) / greatest(length, length2)::double"


@query(_sql(SIG, OK, SITE, PAIRS, select=f"SELECT target, base, {DIST} AS distance, CASE WHEN op2 = 'I' AND abs(start - start2) < 500 AND least(length, length2) / greatest(length, length2)::double >= 0.8 THEN start ELSE start2 END AS start2 FROM cand"))
def q_span_distance(spark, d):
    c = F.col
    x = _pairs(spark, d).withColumn("distance", C.span_distance(c("start"), c("start") + c("length"), c("start2"), c("start2") + c("length2"), c("length")))
    return compare.snapped(x).select("target", "base", "distance", "start2")


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = ("ACGT" * 13)[: len(LETTERS)]
KMER = f"""kb AS (SELECT doc_id AS id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}') AS ref FROM documents),
kq AS (SELECT id, ref, CASE WHEN id % 2 = 0 THEN q ELSE reverse(translate(q, 'ACGT', 'TGCA')) END AS q FROM (SELECT *, substr(ref, length(ref) // 3 + 1, length(ref) // 3) AS q FROM kb)),
ks AS (SELECT id, 'r' AS side, ref AS b FROM kq UNION ALL SELECT id, '+', q FROM kq UNION ALL SELECT id, '-', reverse(translate(q, 'ACGT', 'TGCA')) FROM kq),
kc AS (SELECT id, side, cut, substr(b, CAST(cut + 1 AS bigint), 528) AS piece FROM (SELECT id, side, b, unnest(range(0, length(b) - 16, 512)) AS cut FROM ks WHERE length(b) >= 17)),
kk AS (SELECT id, side, cut + i AS pos, substr(piece, CAST(i + 1 AS bigint), 17) AS kmer FROM (SELECT *, unnest(range(0, length(piece) - 16)) AS i FROM kc)),
k1 AS (SELECT id, side, kmer, any_value(pos) AS pos FROM kk GROUP BY ALL HAVING count(*) = 1),
kp AS (SELECT q.id, q.side AS strand, q.pos AS query_pos, r.pos AS ref_pos FROM k1 q JOIN k1 r ON q.id = r.id AND q.kmer = r.kmer WHERE q.side <> 'r' AND r.side = 'r')"""


def _kmer_pairs(spark, d):
    """Each document as a reference, and its middle third as a query, reversed for odd ids."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), LETTERS, BASES).alias("ref"))
    third = F.floor(F.length("ref") / 3).cast("int")
    t = t.withColumn("query", F.substring("ref", third + 1, third))
    return t.withColumn("query", F.when(F.col("id") % 2 == 0, F.col("query")).otherwise(C.reverse_complement(F.col("query"))))


@query(_sql(KMER, select="SELECT * FROM kp"))
def q_kmer_seeds(spark, d):
    return kmers.seeds(_kmer_pairs(spark, d))


@query(_sql(KMER, "kr AS (SELECT *, query_pos - row_number() OVER (PARTITION BY id, strand, ref_pos - query_pos ORDER BY query_pos) AS run FROM kp)", select="SELECT id, strand, min(query_pos) AS query_start, min(ref_pos) AS ref_start, count(*) + 16 AS length FROM kr GROUP BY id, strand, ref_pos - query_pos, run HAVING count(*) + 16 >= 30"))
def q_kmer_segments(spark, d):
    return kmers.pair_segments(_kmer_pairs(spark, d))
