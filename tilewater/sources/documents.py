"""JSON documents: network logs and progress logs. File readers feed the same parsers as text columns do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

HAR_DDL = (
    "struct<log:struct<entries:array<struct<time:double,request:struct<url:string>,"
    "response:struct<status:int,bodySize:bigint,headersSize:bigint,headers:array<struct<name:string,value:string>>,"
    "content:struct<size:bigint,mimeType:string>>>>>>"
)


def scan_har(docs: DataFrame, text: str) -> DataFrame:
    """Network-log documents -> one row per entry, numbered within the document."""
    keep = [c for c in docs.columns if c != text]
    r, q = C("_e.response"), C("_e.request")

    def header(name: str):
        hit = F.filter(r["headers"], lambda h: F.lower(h["name"]) == name)
        return F.coalesce(F.nullif(F.get(hit, F.lit(0))["value"], F.lit("")), F.lit("(none)"))

    return docs.withColumn("_h", F.from_json(text, HAR_DDL)).select(*keep, F.posexplode("_h.log.entries").alias("entry", "_e")).select(
        *keep, "entry", q["url"].alias("url"), r["status"].alias("status"), r["content"]["mimeType"].alias("mime"),
        F.coalesce(r["bodySize"], F.lit(-1)).alias("body_size"), F.coalesce(r["headersSize"], F.lit(-1)).alias("headers_size"),
        F.coalesce(r["content"]["size"], F.lit(0)).alias("content_size"), F.coalesce(C("_e.time"), F.lit(0.0)).alias("time_ms"),
        header("content-encoding").alias("encoding"), header("cache-control").alias("cache"))


def read_har(spark: SparkSession, path: str) -> DataFrame:
    """One document per file."""
    return scan_har(spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()), "value")


PROGRESS_DDL = "struct<ts:string,event:string,huc:string,error:string,output_bytes:bigint>"


def parse_progress(lines: DataFrame, text: str) -> DataFrame:
    """JSON lines -> ts, event, huc, ...; lines that are not progress events drop out."""
    keep = [c for c in lines.columns if c != text]
    return lines.withColumn("_p", F.from_json(text, PROGRESS_DDL)).where("_p.huc IS NOT NULL AND _p.event IS NOT NULL").select(*keep, "_p.*")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return parse_progress(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()), "value")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    from tilewater.operators.planning import scan_manifest

    return scan_manifest(spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()), "value")
