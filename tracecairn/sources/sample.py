"""Trace rows derived from the ``events`` test table (see FIXTURES.md).

Every event becomes one system call; the two engines differ only in the head.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK_HEAD = """
WITH base AS (SELECT event_id AS log_offset,
  unix_micros(cast(ts AS timestamp))-1704067200000000 AS us, user_id AS pid,
  event_type, value, cast(get_json_object(props,'$.k') AS bigint) AS k FROM events)"""

_DUCKDB_HEAD = """
WITH base AS (SELECT event_id AS log_offset,
  epoch_us(ts)-1704067200000000 AS us, user_id AS pid,
  event_type, value, cast(json_extract_string(props,'$.k') AS bigint) AS k FROM events)"""

_BODY = """
SELECT log_offset, us/1e6 AS machine_ts, lpad(cast(cast(floor(us/6e8) AS bigint) AS varchar(20)),6,'0') AS bucket, pid,
 concat('proc', cast(pid%8 AS varchar(20))) AS comm, sc,
 CASE WHEN kind='open' THEN CASE WHEN k%13=0 THEN '-2' ELSE cast(3+k%6 AS varchar(20)) END WHEN kind='io' THEN cast(nbytes AS varchar(20)) ELSE '0' END AS ret,
 CASE WHEN kind='open' AND k%13=0 THEN '2' ELSE '0' END AS err,
 CASE WHEN kind='open' THEN CASE k%4 WHEN 0 THEN '524288' WHEN 1 THEN '0x80000' WHEN 2 THEN '577' ELSE '1090' END WHEN kind='io' THEN cast(nbytes+100 AS varchar(20)) ELSE '0' END AS arg1,
 CASE WHEN kind='open' THEN '420' WHEN sc IN ('pread64','pwrite64') THEN cast(k*4096 AS varchar(20)) ELSE '0' END AS arg2,
 path,
 CASE WHEN kind='rename' THEN path END AS rename_src, CASE WHEN kind='rename' THEN concat(path,'.new') END AS rename_dst,
 CASE WHEN path LIKE '/mnt/src/%' AND pid%7<>0 THEN concat('/capfs', substr(path,9)) END AS canonical_path,
 CASE WHEN path LIKE '/mnt/src/%' AND pid%7<>0 THEN 1 ELSE 0 END AS mapped,
 CASE pid%3 WHEN 0 THEN 'source' WHEN 1 THEN 'target' ELSE 'other' END AS side
FROM (SELECT *, CASE WHEN sc IN ('open','openat','openat2') THEN 'open' WHEN sc='close' THEN 'close' WHEN sc IN ('read','pread64','readv','write','pwrite64','writev') THEN 'io' WHEN sc LIKE 'rename%' THEN 'rename' ELSE 'meta' END AS kind,
 CASE WHEN event_type IN ('view','click','purchase') AND k%11=0 THEN concat('/[unknown, fd=', cast(3+cast(floor(k/11e0) AS bigint)%6 AS varchar(20)), ']')
  WHEN k=97 THEN '' WHEN k=89 THEN 'rel/f1' WHEN k=83 THEN '/../etc/f0' WHEN k=79 THEN '//etc/f0'
  ELSE concat('/mnt/src/d', cast(k%2 AS varchar(20)), '/f', cast(k%4 AS varchar(20))) END AS path
 FROM (SELECT log_offset, us, pid, event_type, k, cast(floor(value*1e4) AS bigint) AS nbytes,
  CASE event_type WHEN 'signup' THEN CASE k%20 WHEN 0 THEN 'open' WHEN 1 THEN 'openat2' ELSE 'openat' END
   WHEN 'purchase' THEN 'close'
   WHEN 'view' THEN CASE k%3 WHEN 0 THEN 'read' WHEN 1 THEN 'pread64' ELSE 'readv' END
   WHEN 'click' THEN CASE k%3 WHEN 0 THEN 'write' WHEN 1 THEN 'pwrite64' ELSE 'writev' END
   ELSE CASE k%12 WHEN 0 THEN 'newfstatat' WHEN 1 THEN 'statx' WHEN 2 THEN 'mkdir' WHEN 3 THEN 'mkdirat' WHEN 4 THEN 'unlink' WHEN 5 THEN 'unlinkat' WHEN 6 THEN 'rename' WHEN 7 THEN 'renameat' WHEN 8 THEN 'renameat2' WHEN 9 THEN 'getdents64' WHEN 10 THEN 'setxattr' ELSE 'fsync' END END AS sc
  FROM base) b) c"""

# A third of the opens name a directory inside the sandbox, the others a path relative to a
# descriptor, some of them leading out. Ten processes, so that descriptors are met again.
_CHAINED = """
SELECT log_offset, machine_ts, bucket, pid%10 AS pid, comm, sc, ret, err,
 CASE WHEN kind=0 THEN arg1 ELSE cast(3+(log_offset*7+pid)%6 AS varchar(20)) END AS arg1, arg2,
 CASE WHEN sc NOT IN ('open','openat','openat2') THEN path
  WHEN log_offset%3=0 THEN concat('/tmp/sandbox/d', cast(log_offset%4 AS varchar(20)))
  WHEN log_offset%7=0 THEN '../../../../out' ELSE concat('r', cast(log_offset%5 AS varchar(20))) END AS path,
 rename_src, rename_dst, CASE WHEN kind=0 THEN canonical_path END AS canonical_path,
 CASE WHEN kind=0 AND sc NOT IN ('open','openat','openat2') THEN mapped ELSE 0 END AS mapped, side
FROM (SELECT t.*, CASE WHEN sc IN ('open','openat','openat2') AND log_offset%3<>0 THEN 1 ELSE 0 END AS kind
 FROM ({trace}) t) s"""

# Every fsync is the end of its process.
_EXITING = """
SELECT log_offset, machine_ts, bucket, pid, comm, CASE WHEN sc='fsync' THEN 'exit_group' ELSE sc END AS sc,
 ret, err, arg1, arg2, path, rename_src, rename_dst, canonical_path, mapped, side FROM ({trace}) t"""

TRACE_SQL = _DUCKDB_HEAD + _BODY
CHAINED_SQL = _CHAINED.replace("{trace}", TRACE_SQL)
EXITING_SQL = _EXITING.replace("{trace}", TRACE_SQL)


def trace_of(events: DataFrame, around: str = "{trace}") -> DataFrame:
    """The whole ``events`` table as raw trace rows. Its timestamps count as UTC."""
    spark = events.sparkSession
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        inner = _SPARK_HEAD.replace("FROM events", "FROM {events}") + _BODY
        return spark.sql(around.replace("{trace}", inner), events=events)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def sample_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def chained_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample with opens of relative paths that depend on each other."""
    return trace_of(spark.read.parquet(f"{sf_dir}/events.parquet"), _CHAINED)


def exiting_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample with processes that end and begin anew."""
    return trace_of(spark.read.parquet(f"{sf_dir}/events.parquet"), _EXITING)
