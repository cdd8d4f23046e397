"""Text sources: Zeek logs, syslog lines, headerless CSV, line lists, JSON documents, hash lists.

Bad lines are dropped where the source does so; ``siftline.operators.bad_rows`` keeps their reasons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.text import make_label

ZEEK_TYPES = {"time": "timestamp", "count": "bigint", "int": "bigint", "port": "int", "double": "double", "interval": "double", "bool": "boolean"}


def zeek_header(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Names and types from the header lines of a Zeek log."""
    head = {}
    for (line,) in spark.read.text(path).where(F.col("value").startswith("#")).limit(100).collect():
        tag, *rest = line.split("\t")
        head.setdefault(tag, rest)
    if "#fields" not in head:
        raise ValueError("no #fields line")
    return head["#fields"], head.get("#types") or ["string"] * len(head["#fields"])


def zeek(spark: SparkSession, path: str, max_rows: int | None = None, typed: bool = True) -> DataFrame:
    """Rows of a Zeek log by its header; rows with fewer fields than the header are dropped; ``-`` is null where typed."""
    names, kinds = zeek_header(spark, path)
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    if max_rows is not None:
        rows = rows.limit(max_rows)
    parts = rows.select(F.split("value", "\t").alias("p")).where(F.size("p") >= len(names))

    def cell(i: int, kind: str):
        raw = F.get("p", F.lit(i))
        if not typed:
            return raw
        raw = F.nullif(raw, F.lit("-"))
        if kind == "time":
            return F.timestamp_seconds(raw.try_cast("double"))
        if kind == "bool":
            return F.when(raw == "T", True).when(raw == "F", False)
        if kind.startswith(("set[", "vector[")):
            return F.when(raw == "(empty)", F.array().cast("array<string>")).otherwise(F.split(raw, ","))
        return raw.try_cast(ZEEK_TYPES.get(kind, "string"))

    return parts.select(*[cell(i, k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])


def syslog_tokens(lines: DataFrame, year: int, column: str = "value") -> DataFrame:
    """``ts, features, label, type`` of lines that begin with month, day and time; others and short ones are dropped."""
    p = F.filter(F.split(F.col(column), r"\s+"), lambda x: x != "")
    x = lines.withColumn("_p", p).where(F.size("_p") >= 5)
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.lit(str(year)), F.slice("_p", 1, 3).getItem(0), F.lpad(F.get("_p", F.lit(1)), 2, "0"), F.get("_p", F.lit(2))), F.lit("yyyy MMM dd HH:mm:ss"))
    stamp = F.when(F.get("_p", F.lit(0)).rlike("^[A-Z][a-z]{2}$") & F.get("_p", F.lit(1)).rlike(r"^\d{1,2}$") & F.get("_p", F.lit(2)).rlike(r"^\d{2}:\d{2}:\d{2}$"), stamp)
    x = x.withColumn("ts", stamp).where("ts is not null").withColumn("features", F.expr("slice(_p, 5, greatest(size(_p) - 4, 1))"))
    return x.withColumn("label", make_label(F.col("features"))).withColumn("type", F.substring_index(F.get("features", F.lit(0)), "[", 1)).drop("_p")


MDL_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("date", "domain", "ip", "reverse", "description", "registrant", "asn")] + [T.StructField(n, T.IntegerType()) for n in ("inactive", "country")])


def headerless_csv(spark: SparkSession, path: str, schema: T.StructType = MDL_SCHEMA) -> DataFrame:
    """CSV with given names; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").csv(path)


def line_list(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One trimmed text a line, without empty lines."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON documents, one a file, with ``file``, ``label`` (parent folder) and ``file_sha256`` (from the name) added."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    name = F.input_file_name()
    return df.select("*", name.alias("file"), F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("label"), F.regexp_extract(name, r"([0-9a-f]{64})", 1).alias("file_sha256"))


ENGINE_SCANS = "md5 string, sha1 string, sha256 string, resource string, scan_id string, scan_date string, permalink string, verbose_msg string, positives int, total int, response_code int, scans map<string, struct<detected: boolean, version: string, result: string, update: string>>"


def listed(df: DataFrame, hashes: DataFrame, key: str = "file_sha256", keep: bool = True) -> DataFrame:
    """Rows whose hash is (or is not) in a list."""
    return df.join(hashes.select(F.lower(F.trim(hashes.columns[0])).alias(key)), key, "left_semi" if keep else "left_anti")
