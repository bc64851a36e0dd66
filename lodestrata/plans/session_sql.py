"""Questions to SQL over views: guards, row cap, timeout, caches, retries, history."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
from collections import OrderedDict
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Registry

R = Registry()
_WRITES = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|merge|replace|grant|revoke|call|copy|attach)\b", re.I)
_LIMIT = re.compile(r"\blimit\s+\d+", re.I)


class SqlGenerator(Protocol):
    def generate(self, prompt: str) -> str: ...


@dataclass
class QueryResult:
    question: str
    sql: str
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    error: str | None = None
    cached: bool = False
    attempts: int = 0

    @property
    def ok(self) -> bool:
        return self.error is None

    def pretty(self, n: int = 20) -> str:
        if self.error:
            return f"error: {self.error}"
        return "\n".join(" | ".join(map(str, r)) for r in [self.columns, *self.rows[:n]])

    def to_dataframe(self, spark: SparkSession, schema: str) -> DataFrame:
        """N-10: the rows, which the cap bounds, as a DataFrame of the schema; an error gives none."""
        return spark.createDataFrame(self.rows, schema)


def strip_fences(text: str) -> str:
    """N-04."""
    m = re.search(r"```(?:\w+)?\s*(.*?)```", text, re.S)
    return (m[1] if m else text).strip().rstrip(";").strip()


def check_read_only(spark: SparkSession, sql: str, strict: bool = True) -> None:
    """N-01: writing keywords are refused (strict: inside literals too), and statements that Spark parses as commands."""
    text = sql if strict else re.sub(r"'(?:[^']|'')*'", "''", sql)
    if m := _WRITES.search(text):
        raise PermissionError(f"only reading is allowed, not {m[1].upper()}")
    if not re.match(r"\s*(with|select|\(|values|from|table)\b", sql, re.I):
        raise PermissionError("only queries are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    for kind in ("Command", "ParsedStatement"):
        if spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{kind}").isInstance(plan):
            raise PermissionError("only queries are allowed, this is a command")


def capped(df: DataFrame, sql: str, most: int = 10_000, outer: bool = True) -> DataFrame:
    """N-02, S-07: at most so many rows; not outer: any LIMIT in the text, even in a subquery, takes the cap's place."""
    return df if not outer and _LIMIT.search(sql) else df.limit(most)


def run_with_timeout(spark: SparkSession, df: DataFrame, seconds: float) -> list:
    """N-03: rows, or TimeoutError after the time, the job being cancelled by its tag."""
    tag = f"timed-{time.time_ns()}"
    late = threading.Event()

    def stop():
        late.set()
        spark.interruptTag(tag) if hasattr(spark, "interruptTag") else spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.addTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)


class FifoCache:
    """N-05: at most so many entries; the oldest goes first, reading does not refresh."""

    def __init__(self, size: int = 20):
        self.size, self.rows = size, OrderedDict()

    def get(self, key):
        return self.rows.get(key)

    def set(self, key, value) -> None:
        if key not in self.rows and len(self.rows) >= self.size:
            self.rows.popitem(last=False)
        self.rows[key] = value


class Conversation:
    """N-05 to N-09: ask() generates SQL from the schema and the last good turns, checks, runs, retries with the error,
    remembers; history can be stored and resumed."""

    def __init__(self, spark: SparkSession, generator: SqlGenerator, session_id: str = "s", most: int = 10_000, timeout: float = 30.0, attempts: int = 3):
        self.spark, self.generator, self.session_id = spark, generator, session_id
        self.most, self.timeout, self.attempts = most, timeout, attempts
        self.by_question, self.by_sql, self.history = FifoCache(), FifoCache(), []

    @staticmethod
    def key(question: str) -> str:
        return re.sub(r"\s+", " ", question).strip().lower()

    def schema_text(self) -> str:
        return "\n".join(f"{t.name}({', '.join(f'{c.name} {c.dataType}' for c in self.spark.catalog.listColumns(t.name))})" for t in self.spark.catalog.listTables())

    def prompt(self, question: str, error: str | None = None, sql: str | None = None) -> str:
        turns = [h for h in self.history if h.ok][-3:]
        out = [self.schema_text(), *[f"Q: {h.question}\nSQL: {h.sql}" for h in turns], f"Q: {question}"]
        if error:
            out.append(f"SQL: {sql}\nError: {error[:400]}\nCorrect the SQL.")
        return "\n".join(out)

    def ask(self, question: str) -> QueryResult:
        if (hit := self.by_question.get(self.key(question))) is not None:
            return QueryResult(question, hit.sql, hit.columns, hit.rows, None, True, 0)
        error = sql = None
        out = QueryResult(question, "")
        for n in range(1, self.attempts + 1):
            sql = strip_fences(self.generator.generate(self.prompt(question, error, sql)))
            digest = hashlib.md5(sql.encode()).hexdigest()
            if (hit := self.by_sql.get(digest)) is not None:
                out = QueryResult(question, sql, hit.columns, hit.rows, None, True, n)
                break
            try:
                check_read_only(self.spark, sql)
                df = capped(self.spark.sql(sql), sql, self.most)
                out = QueryResult(question, sql, df.columns, [tuple(r) for r in run_with_timeout(self.spark, df, self.timeout)], None, False, n)
                self.by_sql.set(digest, out)
                break
            except Exception as e:
                error = str(e)
                out = QueryResult(question, sql, error=error[:400], attempts=n)
                if isinstance(e, PermissionError):
                    break
        if out.ok:
            self.by_question.set(self.key(question), out)
        self.history.append(out)
        return out

    def save(self, path: str) -> None:
        """Append the turns to a history table."""
        rows = [(self.session_id, n, h.question, h.sql, h.columns, json.dumps(h.rows, default=str), h.error, h.cached, h.attempts) for n, h in enumerate(self.history)]
        self.spark.createDataFrame(rows, "session_id string, turn int, question string, sql string, columns array<string>, rows string, error string, cached boolean, attempts int").write.mode("append").parquet(path)

    def resume(self, path: str) -> None:
        """This session's turns, and caches warmed by them."""
        for r in self.spark.read.parquet(path).where(F.col("session_id") == self.session_id).orderBy("turn").collect():
            h = QueryResult(r["question"], r["sql"], list(r["columns"]), [tuple(x) for x in json.loads(r["rows"])], r["error"], r["cached"], r["attempts"])
            self.history.append(h)
            if h.ok:
                self.by_question.set(self.key(h.question), h)


def sessions(history: DataFrame) -> DataFrame:
    """N-07: sessions by their first turn."""
    return history.groupBy("session_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns")).orderBy("first_turn", "session_id")


@R.query("ns_capped", "N-02 S-07", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 25")
def _(spark, d):
    from .registry import run_sql

    sql = "SELECT p_partkey FROM part ORDER BY p_partkey"
    return capped(run_sql(spark, d, sql), sql, 25)


@R.query("ns_history", "N-07", "SELECT conv_id AS session_id, min(turn) AS first_turn, count(*) AS turns FROM conversations GROUP BY conv_id")
def _(spark, d):
    from ..session import table

    return sessions(table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id"))


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
