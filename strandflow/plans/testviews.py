"""Genomic views of the star-schema test tables, in SQL that Spark and the oracle's engine both read.

Positions follow the part key, so depth stays the same at every scale. Only integer arithmetic and
string functions with one meaning in both engines are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.schemas import TAG

ALIGNMENTS = """
SELECT 'q' || CAST(l_orderkey AS STRING) AS qname,
       CAST(CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE 1 END + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END
            + CASE WHEN l_orderkey % 11 = 0 THEN 0 WHEN l_linestatus = 'O' THEN 64 ELSE 128 END + CASE WHEN l_linenumber = 7 THEN 4 ELSE 0 END
            + CASE WHEN l_suppkey % 10 = 9 THEN 1024 ELSE 0 END + CASE WHEN l_partkey % 13 = 0 AND l_linenumber <> 7 THEN 256 ELSE 0 END AS INT) AS flag,
       CASE WHEN l_linenumber = 7 AND l_partkey % 2 = 0 THEN NULL ELSE 'chr' || CAST(l_suppkey % 5 AS STRING) END AS rname,
       CASE WHEN l_linenumber = 7 AND l_partkey % 2 = 0 THEN NULL ELSE CAST(1 + l_partkey * 37 AS INT) END AS pos,
       CAST(l_quantity AS INT) AS mapq,
       CASE l_linenumber WHEN 1 THEN '10M' WHEN 2 THEN '5M2D5M' WHEN 3 THEN '4M3I3M' WHEN 4 THEN '2S8M' WHEN 5 THEN '5M100N5M' WHEN 6 THEN '3M1P1I6M' END AS cigar,
       'chr' || CAST(l_suppkey % 4 AS STRING) AS mrnm, CAST(101 + l_partkey * 37 AS INT) AS mpos, CAST(110 AS INT) AS isize,
       substr(repeat('ACGTN=', 4), 1 + CAST(l_partkey % 6 AS INT), 10) AS seq,
       substr(repeat('!+5?IJ#', 3), 1 + CAST(l_suppkey % 7 AS INT), 10) AS qual,
       CAST(l_linenumber AS INT) AS nm, 'rg' || CAST(l_suppkey % 3 AS STRING) AS rg, 'f' || CAST(l_suppkey % 3 AS STRING) AS file
FROM {lineitem}
"""
RANGES = """
SELECT CAST(p_partkey AS BIGINT) AS range_id, 'chr' || CAST(p_partkey % 6 AS STRING) AS contig, CAST(1 + p_partkey * 53 AS INT) AS "start", CAST(p_partkey * 53 + p_size * 4 AS INT) AS "end" FROM {part}
"""
CONTIGS = "SELECT CAST(r_regionkey AS INT) AS tid, 'chr' || CAST(r_regionkey AS STRING) AS name, CAST(100000000 AS INT) AS length FROM {region}"
PAIRED = """
SELECT CAST(o_orderkey * 4 + i AS BIGINT) AS "key", 'lib.o' || CAST(o_orderkey AS STRING) || '/' || CAST(i AS STRING) AS full_name, 'o' || CAST(o_orderkey AS STRING) AS qname,
       CAST(CASE WHEN i = 1 THEN 99 ELSE 147 END AS INT) AS flag, 'chr' || CAST(o_custkey % 3 AS STRING) AS rname, 'chr' || CAST(o_custkey % 3 AS STRING) AS mrnm,
       CAST(1 + o_orderkey * 37 + CASE WHEN i = 1 THEN 0 ELSE 100 END AS INT) AS pos,
       CAST(1 + o_orderkey * 37 + CASE WHEN i = 1 THEN 100 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS mpos
FROM {orders} CROSS JOIN (VALUES (1), (2), (3)) AS v(i) WHERE i < 3 OR o_orderkey % 7 = 0
"""
SEQUENCES = "SELECT CAST(doc_id AS BIGINT) AS doc_id, 'd' || CAST(doc_id AS STRING) AS name, {letters} AS seq FROM {documents}"
TABLE_LINES = """
SELECT event_type || chr(9) || CAST(1 + event_id * 10 AS STRING) || chr(9) || CAST(6 + event_id * 10 AS STRING) || chr(9) || CAST(user_id AS STRING) AS line FROM {events}
"""
TABLE_RANGES = """
SELECT CAST(c_custkey AS BIGINT) AS range_id, CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END AS contig,
       CAST(1 + c_custkey * 97 AS INT) AS "start", CAST(c_custkey * 97 + 200 AS INT) AS "end" FROM {customer}
"""
PILEUP_TEXT = """
SELECT event_id AS line_no, event_type AS space, CAST(1 + event_id AS INT) AS position, CASE WHEN event_id % 6 = 0 THEN '*' ELSE substr('ACGT', 1 + CAST(event_id % 4 AS INT), 1) END AS "referenceBase",
       CASE WHEN event_id % 6 = 0 THEN '*/+A' ELSE substr('RYSW', 1 + CAST(user_id % 4 AS INT), 1) END AS "consensusBase", CAST(event_id % 50 AS INT) AS "consensusQuality", CAST(event_id % 40 AS INT) AS "snpQuality",
       CAST(60 AS INT) AS "maxMappingQuality", CAST(event_id % 30 AS INT) AS coverage, '*' AS "alleleOne", '+A' AS "alleleTwo", CAST(event_id % 9 AS INT) AS "alleleOneSupport", CAST(event_id % 8 AS INT) AS "alleleTwoSupport",
       CAST(event_id % 3 AS INT) AS "additionalIndels"
FROM {events}
"""
VARIANT_LINES = """
SELECT 'chr' || CAST(p_partkey % 6 AS STRING) || chr(9) || CAST(1 + p_partkey * 53 AS STRING) || chr(9) || CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE 'rs' || CAST(p_partkey AS STRING) END || chr(9)
       || substr('ACGTACGT', 1 + CAST(p_partkey % 4 AS INT), 1 + CAST(p_partkey % 3 AS INT)) || chr(9) || CASE WHEN p_partkey % 5 = 0 THEN 'A,T' ELSE 'G' END || chr(9)
       || CASE WHEN p_partkey % 7 = 0 THEN '.' ELSE CAST(p_size AS STRING) END || chr(9) || 'PASS' || chr(9) || 'DP=' || CAST(p_size AS STRING) || ';DB' || CASE WHEN p_partkey % 4 = 0 THEN ';DP=0;DB=again' ELSE '' END || chr(9) || 'GT:PL:DP:XX:XX' || chr(9)
       || '0/1:' || CAST(p_size AS STRING) || ',0,9:.:a:again' || chr(9) || CASE WHEN p_partkey % 3 = 0 THEN './.' ELSE '1/1:0,3,' || CAST(p_size AS STRING) || ':7:b:again' END AS line
FROM {part}
"""


def view(spark: SparkSession, sf_dir: str, sql: str, spread: bool = False, **words: str) -> DataFrame:
    """A view as a DataFrame; {name} is a table or one of the words.

    With `spread`, for queries that unfold their rows, a table of fewer splits than cores is dealt out first.
    """
    cores = spark.sparkContext.defaultParallelism

    def read(table: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df

    tables = {t: read(t) for t in ("lineitem", "part", "region", "orders", "documents", "events", "customer") if "{%s}" % t in sql}
    for k, v in words.items():
        sql = sql.replace("{%s}" % k, v)
    return spark.sql(sql.replace('"', "`"), **tables)


def in_oracle(sql: str, **words: str) -> str:
    for t in ("lineitem", "part", "region", "orders", "documents", "events", "customer"):
        sql = sql.replace("{%s}" % t, t)
    for k, v in words.items():
        sql = sql.replace("{%s}" % k, v)
    return sql


def alignments(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Alignments with NM and RG tags, and the file they are in."""
    tag = lambda kind, i, s: f"named_struct('type', '{kind}', 'i', {i}, 'd', CAST(NULL AS DOUBLE), 's', {s}, 'ai', CAST(NULL AS ARRAY<BIGINT>), 'ad', CAST(NULL AS ARRAY<DOUBLE>))"
    tags = F.expr(f"map('NM', {tag('i', 'CAST(nm AS BIGINT)', 'CAST(NULL AS STRING)')}, 'RG', {tag('Z', 'CAST(NULL AS BIGINT)', 'rg')})").cast(f"map<string,{TAG}>")
    return view(spark, sf_dir, ALIGNMENTS, spread).withColumn("tags", tags).drop("nm", "rg")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RANGES)


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CONTIGS)


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PAIRED)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SEQUENCES, letters="regexp_replace(text, '[^ACGTNacgtn]', '')")
