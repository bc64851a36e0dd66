"""Scalar functions over strings, JSON, arrays and maps, as column expressions; Python only for tolerant JSON,
token-sort similarity and table text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import table

R = Registry()


def normalize(c: Column) -> Column:
    """White space collapsed, lower case, trimmed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def owner_and_text(c: Column) -> Column:
    """'Owner: text' split at the first colon; without one, the owner is empty."""
    has = F.instr(c, ":") > 0
    return F.struct(F.when(has, F.trim(F.substring_index(c, ":", 1))).otherwise("").alias("owner"), F.when(has, F.trim(F.regexp_replace(c, r"^[^:]*:", ""))).otherwise(F.trim(c)).alias("text"))


def safe_name(c: Column) -> Column:
    """File name: other than word characters become _, at most 120, with .md."""
    return F.concat(F.substring(F.regexp_replace(c, r"[^\w\-]+", "_"), 1, 120), F.lit(".md"))


def strip_html(c: Column) -> Column:
    """Tags become spaces."""
    return F.regexp_replace(c, r"<[^>]*>", " ")


def mentions(c: Column, products: list[str]) -> Column:
    """The given words that the text has, sorted."""
    return F.array_sort(F.filter(F.array(*map(F.lit, sorted(set(products)))), lambda p: F.contains(F.lower(c), F.lower(p))))


def title_of(c: Column, stem: Column) -> Column:
    """The first '# ' heading of the first ten lines, else the file's stem."""
    head = F.filter(F.slice(F.split(c, "\n"), 1, 10), lambda s: s.startswith("# "))
    return F.coalesce(F.trim(F.substring(F.get(head, F.lit(0)), 3, 10_000)), stem)


def front_matter(c: Column) -> Column:
    """'key: value' lines between the first two '---' lines, as a map (empty without)."""
    block = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---", 1)
    pairs = F.transform(F.filter(F.split(block, "\n"), lambda s: F.instr(s, ":") > 1), lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)), F.trim(F.regexp_replace(s, r"^[^:]*:", ""))))
    return F.map_from_entries(pairs)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def cache_key(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 24)


def json_contains(c: Column, want: dict) -> Column:
    """Containment of a flat object: every key has the value."""
    out = F.lit(True)
    for k, v in want.items():
        out = out & F.coalesce(F.get_json_object(c, f"$.{k}") == F.lit(str(v).lower() if isinstance(v, bool) else str(v)), F.lit(False))
    return out


def json_has(c: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(c), key)


def json_set(c: Column, **values) -> Column:
    """Keys of a flat object set to the given values, those given as None removed."""
    m = F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(m, lambda k, _: ~k.isin(list(values)))
    new = [x for k, v in values.items() if v is not None for x in (F.lit(k), F.lit(str(v)))]
    return F.to_json(F.map_concat(kept, F.create_map(*new).cast("map<string,string>")) if new else kept)


def json_strip_nulls(c: Column) -> Column:
    return F.to_json(F.map_filter(F.from_json(c, "map<string,string>"), lambda _, v: v.isNotNull()))


_FENCE = re.compile(r"^\s*```[\w-]*\s*|\s*```\s*$")


def tolerant_json(text: str | None):
    """The first JSON object of a text with fences, chatter, control characters or trailing commas; else {}."""
    if not text:
        return {}
    s = _FENCE.sub("", text)
    start = s.find("{")
    if start < 0:
        return {}
    s = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", s[start:])
    for x in (s, re.sub(r",\s*([}\]])", r"\1", s)):
        try:
            return json.JSONDecoder(strict=False).raw_decode(x)[0]
        except ValueError:
            continue
    return {}


def flat_object(text: str | None) -> dict:
    """The first flat {...} object of a text, else {}."""
    for m in re.finditer(r"\{[^{}]*\}", text or ""):
        try:
            return json.loads(m[0])
        except ValueError:
            continue
    return {}


def common_length(x: str, y: str) -> int:
    """The length of the longest common subsequence, a column of bits at a time."""
    at: dict[str, int] = {}
    for k, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << k
    every = v = (1 << len(x)) - 1
    for c in y:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & every
    return len(x) - v.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    """Similarity 0 to 100 of two texts with their words sorted: twice the longest common subsequence by total length."""
    x, y = (" ".join(sorted(s.lower().split())) for s in (a, b))
    return 200.0 * common_length(x, y) / (len(x) + len(y)) if x or y else 100.0


def token_sort(a, b) -> Column:
    """token_sort_ratio of two columns, by Arrow batches."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else token_sort_ratio(x, y) for x, y in zip(a, b)])

    return F.pandas_udf(run, "double")(a, b)


def table_rows(text: str) -> list[list[str]]:
    """Rows of a Markdown, HTML, tab- or comma-separated table."""
    if "<td" in text.lower() or "<th" in text.lower():
        return [[re.sub(r"<[^>]*>", "", c).strip() for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r)] for r in re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", text)]
    lines = [x for x in text.strip().split("\n") if x.strip()]
    if lines and lines[0].lstrip().startswith("|"):
        return [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines if not re.fullmatch(r"[\s|:\-]+", x)]
    import csv

    return [[c.strip() for c in r] for r in csv.reader(lines, delimiter="\t" if "\t" in text else ",")]


def table_markdown(text: str) -> str:
    """A table as Markdown, padded to its widest row."""
    rows = table_rows(text)
    if not rows:
        return ""
    n = max(map(len, rows))
    rows = [r + [""] * (n - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * n, *rows[1:]])


def table_records(text: str) -> list[dict[str, str]]:
    """I-26: rows as maps by header; empty cells are dropped before names are given, so later ones move up."""
    rows = table_rows(text)
    return [dict(zip(rows[0], [c for c in r if c])) for r in rows[1:]] if rows else []


R.sql("sc_strings", "functions/string", "SELECT p_partkey, left(p_name, 5) AS l, CAST(length(p_name) AS BIGINT) AS n, upper(p_brand) AS u, lower(trim(regexp_replace(p_type, '\\\\s+', ' '))) AS norm FROM part", "SELECT p_partkey, left(p_name, 5) AS l, CAST(length(p_name) AS BIGINT) AS n, upper(p_brand) AS u, lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS norm FROM part")
R.sql("sc_dates", "functions/date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(CAST(o_orderdate - INTERVAL '7' DAY AS DATE) AS STRING) AS before FROM orders")
R.sql("sc_math", "functions/math", "SELECT p_partkey, CAST(floor(p_size / 10) * 10 AS BIGINT) AS decade, CAST(round(CAST(ln(p_retailprice) / ln(2) AS DECIMAL(38,12)), 6) AS DOUBLE) AS lg FROM part")
R.sql("sc_hashes", "functions/hash", "SELECT doc_id, md5(text) AS m, substring(sha2(text, 256), 1, 24) AS s FROM documents", "SELECT doc_id, md5(text) AS m, substring(sha256(text), 1, 24) AS s FROM documents")


@R.query("sc_strip_html", "functions/string DML-15", "SELECT page_id, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS n, md5(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS h FROM pages")
def _(spark, d):
    t = strip_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("h"))


@R.query("sc_word_count", "functions/string", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n]+')) AS BIGINT) AS words, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[^ \t\n]+")).cast("long").alias("words"), F.size(F.split("text", "\n")).cast("long").alias("lines"), token_estimate(F.col("text")).alias("tokens"))


@R.query("sc_owner_split", "functions/string", "SELECT o_orderkey, trim(split_part(o_orderpriority, '-', 1)) AS owner, substring(o_orderpriority, strpos(o_orderpriority, '-') + 1) AS rest FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    got = owner_and_text(F.regexp_replace("o_orderpriority", "-", ":"))
    return o.select("o_orderkey", got["owner"].alias("owner"), got["text"].alias("rest"))


@R.query("sc_mentions", "functions/string", "SELECT p_partkey, array_to_string(list_sort(list_filter(['LARGE','MEDIUM','PROMO','SMALL','STANDARD'], lambda x: contains(lower(p_type), lower(x)))), ',') AS m FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(mentions(F.col("p_type"), ["SMALL", "PROMO", "STANDARD", "LARGE", "MEDIUM"]), ",").alias("m"))


@R.query("sc_json_path", "functions/JSON SRC-25", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@R.query("sc_json_keys", "functions/JSON", "SELECT event_id FROM events WHERE json_extract(props, '$.k') = 87 AND list_contains(json_keys(props), 'k') AND NOT list_contains(json_keys(props), 'zz')")
def _(spark, d):
    p = F.col("props")
    return table(spark, d, "events").where(json_contains(p, {"k": 87}) & json_has(p, "k") & ~json_has(p, "zz")).select("event_id")


@R.query("sc_json_set_each", "functions/JSON", "SELECT event_id, 'a' AS k, '1' AS v FROM events UNION ALL SELECT event_id, 'k', CAST(json_extract(props, '$.k') AS VARCHAR) FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.explode(F.from_json(json_set(F.col("props"), a=1, zz=None), "map<string,string>")).alias("k", "v"))


@R.query("sc_arrays", "functions/array A-14", "SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment))), '|') AS segs, CAST(len(list_distinct(list(c_mktsegment))) AS BIGINT) AS n FROM customer GROUP BY 1")
def _(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("segs"), F.size(F.collect_set("c_mktsegment")).cast("long").alias("n"))


@R.query("sc_tag_frequency", "A-14", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) t GROUP BY tag")
def _(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


#: Documents as Markdown: front matter before every other one, a heading before every third.
MARKDOWN = "concat(CASE WHEN doc_id % 2 = 0 THEN concat('---', chr(10), 'lang: ', coalesce(lang, ''), chr(10), 'source: ', coalesce(source, ''), chr(10), '---', chr(10)) ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN concat('#  About ', coalesce(source, ''), ' ', chr(10)) ELSE '' END, coalesce(text, ''))"


@R.query("sc_title_front_matter", "functions/string", f"""WITH m AS (SELECT doc_id, {MARKDOWN} AS t FROM documents)
SELECT doc_id, coalesce(trim(substr(list_filter(string_split(t, chr(10))[1:10], lambda x: starts_with(x, '# '))[1], 3)), concat('doc-', doc_id)) AS title,
    CAST(len(list_filter(string_split(regexp_extract(t, '(?s)\\A---\\n(.*?)\\n---', 1), chr(10)), lambda x: instr(x, ':') > 1)) AS BIGINT) AS keys FROM m""")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr(MARKDOWN).alias("text"))
    return t.select("doc_id", title_of(F.col("text"), F.concat(F.lit("doc-"), F.col("doc_id"))).alias("title"), F.size(front_matter(F.col("text"))).cast("long").alias("keys"))


@R.query("sc_token_sort", "functions/string")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", token_sort("p_name", "p_type").alias("ratio"))


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
