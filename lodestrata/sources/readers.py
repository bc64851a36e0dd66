"""Sources and sinks: lazy Parquet directories, CSV and JSON shapes, discovery, exports, catalogue listings."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.registry import Registry
from ..session import table

R = Registry()


def _children(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)


def register_directory(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """SRC-01, SRC-03: each Parquet file or directory below as a view with a lower-case name; no rows are read."""
    out = []
    for s in _children(spark, path):
        name = s.getPath().getName()
        if s.isDirectory() or name.endswith(".parquet"):
            view = prefix + re.sub(r"\.parquet$", "", name).lower()
            spark.read.parquet(s.getPath().toString()).createOrReplaceTempView(view)
            out.append(view)
    return sorted(out)


def parquet_glob(spark: SparkSession, base: str, glob: str) -> DataFrame:
    """SRC-02: partitioned files by a glob, partition columns kept."""
    return spark.read.option("basePath", base).parquet(f"{base}/{glob}")


def csv_named(spark: SparkSession, path: str, names: str, sep: str = ",", header: bool = False) -> DataFrame:
    """SRC-04, SRC-06 to SRC-08: delimited text with a given schema."""
    return spark.read.schema(names).option("sep", sep).option("header", header).csv(path)


def csv_with_year(spark: SparkSession, path: str, names: str, pattern: str = r"yob(\d+)") -> DataFrame:
    """SRC-05: many files, the year from the file's name."""
    return csv_named(spark, path, names).withColumn("year", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("int"))


def sniff(spark: SparkSession, path: str, lines: int = 20) -> dict:
    """SRC-09: delimiter and header of delimited text, from its first lines."""
    text = "\n".join(r[0] for r in spark.read.text(path).limit(lines).collect())
    d = csv.Sniffer().sniff(text, delimiters=",;|\t")
    return {"sep": d.delimiter, "quote": d.quotechar, "header": csv.Sniffer().has_header(text)}


def melt_matrix(wide: DataFrame, key: str, pattern: str = "^[A-Z]{3}$", name: str = "year", value: str = "value") -> DataFrame:
    """SRC-10: a wide matrix as long rows, keys of the pattern only, missing values dropped."""
    cols = [c for c in wide.columns if re.fullmatch(r"\d+", c)]
    return wide.where(F.col(key).rlike(pattern)).unpivot([key], cols, name, value).where(F.col(value).isNotNull())


MEETING = "meetingId string, title string, organizerEmail string, host string, startTime string, endTime string, duration double, allEmails array<string>, invitees array<string>"
SUMMARY = "meetingId string, summary string, overallSentiment string, sentimentScore double, topics array<string>, actionItems array<string>, keyMoments array<struct<time:double,text:string,type:string,speaker:string>>"


def meeting_star(spark: SparkSession, root: str, products: list[str] = ("Comply", "Detect", "Identity", "Protect")) -> dict[str, DataFrame]:
    """SRC-11: a directory of meeting folders as meetings, participants, summaries, key_moments, action_items."""
    from ..functions.scalars import mentions, owner_and_text

    read = lambda s, n: spark.read.schema(s).option("multiLine", True).json(f"{root}/*/{n}.json")
    m, s = read(MEETING, "meeting-info"), read(SUMMARY, "summary")
    item = owner_and_text(F.col("t"))
    return {
        "meetings": m.select(F.col("meetingId").alias("meeting_id"), "title", F.col("organizerEmail").alias("organizer"), F.to_timestamp("startTime").alias("start_time"), F.to_timestamp("endTime").alias("end_time"), "duration"),
        "participants": m.select(F.col("meetingId").alias("meeting_id"), F.explode(F.array_distinct(F.col("allEmails"))).alias("email")),
        "summaries": s.select(F.col("meetingId").alias("meeting_id"), "summary", F.col("overallSentiment").alias("sentiment"), F.col("sentimentScore").alias("score"), "topics", mentions(F.col("summary"), list(products)).alias("products")),
        "key_moments": s.select(F.col("meetingId").alias("meeting_id"), F.posexplode("keyMoments").alias("moment_index", "k")).select("meeting_id", "moment_index", "k.time", "k.text", "k.type", "k.speaker"),
        "action_items": s.select(F.col("meetingId").alias("meeting_id"), F.posexplode("actionItems").alias("item_index", "t")).select("meeting_id", "item_index", item["owner"].alias("owner"), item["text"].alias("text")),
    }


SQUAD = "version string, data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<question:string,is_impossible:boolean,answers:array<struct<text:string,answer_start:int>>>>>>>>"


def squad_answers(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12, I-08: (title, question, text, start) of the first paragraph of each title, impossible questions left out.
    The question's name is its first quoted part."""
    d = spark.read.schema(SQUAD).option("multiLine", True).json(path)
    q = d.select(F.explode("data").alias("d")).select("d.title", F.explode(F.get("d.paragraphs", F.lit(0))["qas"]).alias("q")).where(~F.coalesce("q.is_impossible", F.lit(False)))
    name = F.when(F.col("q.question").rlike('"[^"]+"'), F.regexp_extract("q.question", '"([^"]+)"', 1)).otherwise(F.col("q.question"))
    return q.select("title", name.alias("question"), F.explode("q.answers").alias("a")).select("title", "question", "a.text", F.col("a.answer_start").alias("start"))


PATTERNS = ("md", "markdown", "txt", "pdf", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "html", "htm", "mp3", "wav", "m4a", "flac")


def discover(spark: SparkSession, root: str, kinds=PATTERNS) -> DataFrame:
    """SRC-13, SRC-23: (path, kind, length, modified) of files of known kinds, at any depth; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "length", F.col("modificationTime").alias("modified"))
    return d.where(F.col("kind").isin(*kinds)).orderBy("path")


def export_csv(df: DataFrame, path: str) -> None:
    """SRC-14, SRC-15."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """SRC-17."""
    df.write.mode("overwrite").json(path)


def batches(df: DataFrame, size: int = 1000):
    """SRC-16: rows on the driver in batches, partition by partition."""
    out = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        out.append(r)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def cast_stream(df: DataFrame, schema: T.StructType) -> DataFrame:
    """SRC-20: columns cast to a schema, record batch by record batch in the engine; missing ones are null."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that must be there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def tables_of(spark: SparkSession) -> list[str]:
    """SRC-21."""
    return sorted(t.name for t in spark.catalog.listTables())


def describe_table(spark: SparkSession, name: str) -> list[tuple[str, str, bool]]:
    """SRC-21, SRC-22: (column, type, nullable)."""
    return [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(name)]


def land_json(df: DataFrame, kinds: dict[str, str], kind: str = "file_type", payload: str = "payload") -> dict[str, DataFrame]:
    """SRC-24, SRC-25: raw documents (…, file_type, payload) as one parsed DataFrame per type, schema on read."""
    rest = [c for c in df.columns if c not in (kind, payload)]
    return {k: df.where(F.col(kind) == k).select(*rest, F.from_json(payload, s).alias("j")).select(*rest, "j.*") for k, s in kinds.items()}


R.sql("src_partition_ranges", "DML-14", "SELECT CASE WHEN year(o_orderdate) < 1994 THEN 'old' WHEN year(o_orderdate) < 1997 THEN 'mid' ELSE 'new' END AS part, count(*) AS n FROM orders GROUP BY 1")


@R.query("src_delimited_rows", "SRC-26", "SELECT p_partkey, k, v FROM (SELECT p_partkey, 1 AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part) t")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split(F.concat_ws("|", "p_brand", "p_type"), r"\|")).alias("k", "v")).withColumn("k", F.col("k") + 1)


@R.query("src_land_json", "SRC-24 SRC-25", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS s FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("file_type"), F.col("props").alias("payload"))
    got = land_json(e, {"click": "k long", "view": "k long"})
    one = [x.agg(F.sum("k").alias("s")).select(F.lit(k).alias("event_type"), "s") for k, x in got.items()]
    return one[0].unionByName(one[1])


@R.query("src_ordinality", "SRC-25 J-15", "SELECT c_nationkey, n, seg FROM (SELECT c_nationkey, list_sort(list_distinct(list(c_mktsegment))) AS l FROM customer GROUP BY 1) t, LATERAL (SELECT unnest(l) AS seg, CAST(unnest(range(1, len(l) + 1)) AS INT) AS n) u")
def _(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("l"))
    return g.select("c_nationkey", F.posexplode("l").alias("n", "seg")).withColumn("n", F.col("n") + 1)


@R.query("src_catalog", "SRC-01 SRC-21 N-09", "SELECT * FROM (VALUES ('benchmark'), ('conversations'), ('customer'), ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) t(name)")
def _(spark, d):
    return spark.createDataFrame([(n[3:],) for n in register_directory(spark, d, "ls_")], "name string")


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
