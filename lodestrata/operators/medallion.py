"""Bronze, silver and gold tables of extracted entities and relationships, and the risk rules, each one set operation
over all contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize
from ..plans.registry import Registry
from ..session import table
from .graph import LABEL_RELS, LABELS, QUESTION_LABELS
from .rewrites import decimal, distinct_on

R = Registry()
# Risks of missing clauses (name, label that must be there, severity, type) and which risk causes which.
RISK_RULES = [("Missing Indemnity Clause", "IndemnityClause", "HIGH", "compliance_gap"), ("Missing Termination Clause", "TerminationClause", "HIGH", "compliance_gap"), ("Uncapped Liability", "LiabilityClause", "HIGH", "financial_risk"), ("No Governing Law", "Jurisdiction", "MEDIUM", "legal_risk"), ("No Confidentiality Obligation", "ConfidentialityClause", "MEDIUM", "compliance_gap")]
CAUSES = [("No Governing Law", "Missing Indemnity Clause"), ("No Governing Law", "Missing Termination Clause"), ("Missing Indemnity Clause", "Uncapped Liability")]

ENTITY = "array<struct<id:string,label:string,name:string,confidence:double>>"
RELATION = "array<struct<source:string,target:string,rel_type:string,confidence:double,evidence:string>>"


def extract(chunks: DataFrame, extractor, floor: float = 0.7) -> DataFrame:
    """I-10: bronze rows (contract_id, chunk_index, model, entities, relationships) by Arrow batches; items under the
    floor go; if that leaves no relationship, all stay."""
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for c, k, t in zip(b["contract_id"], b["chunk_index"], b["text"]):
                x = extractor.extract(t)
                ents = [{"id": f"{c}-{k}-{n}", "label": e["label"], "name": e["name"], "confidence": float(e["confidence"])} for n, e in enumerate(x["entities"])]
                ids = {e["name"]: e["id"] for e in ents}
                rels = [{"source": ids.get(r["source"]), "target": ids.get(r["target"]), "rel_type": r["rel_type"], "confidence": float(r["confidence"]), "evidence": r.get("evidence", "")} for r in x["relationships"]]
                good = [r for r in rels if r["confidence"] >= floor] or rels
                out.append((c, k, type(extractor).__name__, [e for e in ents if e["confidence"] >= floor], good))
            yield pd.DataFrame(out, columns=["contract_id", "chunk_index", "model", "entities", "relationships"])

    return chunks.select("contract_id", "chunk_index", "text").mapInPandas(run, f"contract_id string, chunk_index int, model string, entities {ENTITY}, relationships {RELATION}")


def stage_entities(bronze: DataFrame, floor: float = 0.7) -> DataFrame:
    """I-11: one row per entity over the floor, labels outside the model coerced to Clause."""
    e = bronze.select("contract_id", "chunk_index", F.explode("entities").alias("e")).select("contract_id", "chunk_index", "e.*").where(F.col("confidence") >= floor)
    return e.withColumn("label", F.when(F.col("label").isin(LABELS), F.col("label")).otherwise("Clause")).withColumn("norm", normalize(F.col("name")))


def canonical_entities(staged: DataFrame) -> DataFrame:
    """I-12: per contract, label and normalised name: the most confident name, chunks as a sorted set, evidence count."""
    key = ["contract_id", "label", "norm"]
    best = distinct_on(staged, key, [F.desc("confidence"), F.asc("chunk_index"), F.asc("id")]).select(*key, "name", "confidence", F.md5(F.concat_ws("|", *key)).alias("canonical_id"))
    more = staged.groupBy(*key).agg(F.array_sort(F.collect_set("chunk_index")).alias("source_chunk_indices"), F.count("*").alias("evidence_count"))
    return best.join(more, key)


def resolve(staged: DataFrame, canonical: DataFrame) -> DataFrame:
    """J-25: raw id -> canonical id; of several writes for one raw id the later chunk wins."""
    key = ["contract_id", "label", "norm"]
    return distinct_on(staged.join(canonical.select(*key, "canonical_id"), key), ["contract_id", "id"], [F.desc("chunk_index"), F.asc("canonical_id")]).select("contract_id", "id", "canonical_id")


def canonical_relations(bronze: DataFrame, ids: DataFrame, floor: float = 0.7) -> DataFrame:
    """I-13: per ends and type the largest confidence and the distinct evidence in order of chunk."""
    r = bronze.select("contract_id", "chunk_index", F.explode("relationships").alias("r")).select("contract_id", "chunk_index", "r.*").where(F.col("confidence") >= floor)
    a, b = (ids.select("contract_id", F.col("id").alias(x), F.col("canonical_id").alias(y)) for x, y in (("source", "src"), ("target", "dst")))
    r = r.join(a, ["contract_id", "source"]).join(b, ["contract_id", "target"])
    packed = F.array_sort(F.collect_list(F.struct("chunk_index", "evidence")))
    return r.groupBy("contract_id", "src", "dst", "rel_type").agg(F.max("confidence").alias("confidence"), F.array_distinct(F.transform(packed, lambda s: s["evidence"])).alias("evidence_texts"))


def gold(canonical: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I-14, I-16: vertices and edges; the first evidence is the edge's property."""
    v = canonical.select(F.col("canonical_id").alias("uuid"), "label", "name", F.col("norm").alias("normalized_name"), F.col("contract_id").alias("document_id"), F.to_json(F.struct("confidence", "evidence_count")).alias("metadata"))
    e = relations.select(F.md5(F.concat_ws("|", "src", "dst", "rel_type", "contract_id")).alias("uuid"), "src", "dst", "rel_type", F.col("contract_id").alias("document_id"), F.to_json(F.struct(F.get("evidence_texts", F.lit(0)).alias("evidence"))).alias("properties"))
    return v, e


def risks(entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I-15: of entities (document_id, label, uuid): risks (document_id, risk, severity, risk_type), edges to parties
    (document_id, risk, party) and causes (document_id, cause, effect). Contracts without a party are skipped."""
    spark = entities.sparkSession
    rules = spark.createDataFrame(RISK_RULES, "risk string, needed string, severity string, risk_type string")  # five rows
    held = entities.groupBy("document_id").agg(F.collect_set("label").alias("labels")).where(F.array_contains("labels", "Party"))
    r = held.crossJoin(F.broadcast(rules)).where(~F.array_contains("labels", F.col("needed"))).select("document_id", "risk", "severity", "risk_type")
    party = r.select("document_id", "risk").join(entities.where("label = 'Party'").select("document_id", F.col("uuid").alias("party")), "document_id")
    need = {risk: label for risk, label, *_ in RISK_RULES}
    # both risks of a pair hold where both labels are absent, which a contract's row of labels says by itself
    pairs = F.array(*[F.when(~F.array_contains("labels", need[a]) & ~F.array_contains("labels", need[b]), F.struct(F.lit(a).alias("cause"), F.lit(b).alias("effect"))) for a, b in CAUSES])
    causes = held.select("document_id", F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).select("document_id", "p.cause", "p.effect")
    return r, party, causes


def extraction_report(bronze: DataFrame) -> DataFrame:
    """E-09: (part, name, value) over all bronze rows: contracts, chunks, entities, relationships, means per chunk, mean
    confidence of the contracts that have any, and counts by label and relation type."""
    e = bronze.select("contract_id", F.explode("entities").alias("e")).select("contract_id", "e.label", "e.confidence")
    r = bronze.select(F.explode("relationships").alias("r")).select("r.rel_type")
    n = bronze.agg(F.countDistinct("contract_id").alias("contracts"), F.count("*").alias("chunks"), F.sum(F.size("entities")).alias("entities"), F.sum(F.size("relationships")).alias("relationships"))
    per = e.groupBy("contract_id").agg(F.avg("confidence").alias("m")).where("m > 0").agg(F.avg("m").alias("mean_confidence"))
    n = n.crossJoin(per)  # one row each
    n = n.withColumn("entities_per_chunk", F.col("entities") / F.nullif("chunks", F.lit(0))).withColumn("relationships_per_chunk", F.col("relationships") / F.nullif("chunks", F.lit(0)))
    total = n.select(F.explode(F.array(*[F.struct(F.lit("total").alias("part"), F.lit(c).alias("name"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in n.columns])).alias("r")).select("r.*")
    by = lambda d, c: d.groupBy(F.col(c).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(c).alias("part"), "name", "value")
    return total.unionByName(by(e, "label")).unionByName(by(r, "rel_type"))


def annotations_to_graph(answers: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I-09, SRC-12: answers (title, question, text) of known documents (title, document_id) as entities with an edge
    entity -> contract; the edge's type follows the label before unknown labels become Clause; empty answers go."""
    rows = [(q, label, LABEL_RELS[label]) for label, qs in QUESTION_LABELS.items() for q in qs]
    dim = answers.sparkSession.createDataFrame(rows, "question string, raw string, rel_type string")  # forty rows
    a = answers.where(F.length(F.trim("text")) > 0).join(documents, "title").join(F.broadcast(dim), "question")
    a = a.withColumn("label", F.when(F.col("raw").isin(LABELS), F.col("raw")).otherwise("Clause")).withColumn("norm", normalize(F.col("text")))
    a = a.withColumn("uuid", F.md5(F.concat_ws("|", "document_id", "label", "norm")))
    v = a.select("uuid", "label", F.col("text").alias("name"), F.col("norm").alias("normalized_name"), "document_id", F.lit("{}").alias("metadata")).dropDuplicates(["uuid"])
    e = a.select(F.md5(F.concat_ws("|", "uuid", "rel_type", "document_id")).alias("uuid"), F.col("uuid").alias("src"), F.col("document_id").alias("dst"), "rel_type", "document_id", F.lit("{}").alias("properties")).distinct()
    return v, e


def _bronze(spark, d) -> DataFrame:
    """Order lines as extracted entities: contract = order, label by flag, name by part; each line is related to the
    first line of its order, type by status."""
    li = table(spark, d, "lineitem").withColumn("first", F.min("l_linenumber").over(Window.partitionBy("l_orderkey")))
    label = F.when(F.col("l_returnflag") == "A", "Party").when(F.col("l_returnflag") == "N", "Jurisdiction").otherwise("IPClause")
    own = F.concat_ws("-", "l_orderkey", "l_linenumber")
    entity = F.struct(own.alias("id"), label.alias("label"), F.concat(F.lit("  Part "), (F.col("l_partkey") % 4).cast("string")).alias("name"), (0.6 + F.col("l_discount") * 4).alias("confidence"))
    kind = F.when(F.col("l_linestatus") == "O", "GOVERNED_BY").otherwise("SIGNED_BY")
    relation = F.struct(own.alias("source"), F.concat_ws("-", "l_orderkey", "first").alias("target"), kind.alias("rel_type"), (0.6 + F.col("l_tax") * 5).alias("confidence"), F.concat_ws(" ", F.lit("line"), "l_linenumber").alias("evidence"))
    e = li.select(F.col("l_orderkey").cast("string").alias("contract_id"), (F.col("l_linenumber") % 3).alias("chunk_index"), entity.alias("e"), F.when(F.col("l_linenumber") != F.col("first"), relation).alias("r"))
    return e.groupBy("contract_id", "chunk_index").agg(F.collect_list("e").alias("entities"), F.collect_list("r").alias("relationships"))


STAGED = """s AS MATERIALIZED (
    SELECT CAST(l_orderkey AS VARCHAR) AS contract_id, l_linenumber % 3 AS chunk_index, concat(l_orderkey, '-', l_linenumber) AS id,
        CASE l_returnflag WHEN 'A' THEN 'Party' WHEN 'N' THEN 'Jurisdiction' ELSE 'Clause' END AS label,
        concat('part ', l_partkey % 4) AS norm, 0.6 + l_discount * 4 AS confidence
    FROM lineitem WHERE 0.6 + l_discount * 4 >= 0.7)"""
IDS = """ids AS MATERIALIZED (
    SELECT contract_id, id, md5(concat_ws('|', contract_id, label, norm)) AS canonical_id FROM s
    QUALIFY row_number() OVER (PARTITION BY contract_id, id ORDER BY chunk_index DESC, md5(concat_ws('|', contract_id, label, norm))) = 1)"""
EDGES = """li AS (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first_line FROM lineitem),
raw AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS contract_id, l_linenumber % 3 AS chunk_index, concat(l_orderkey, '-', l_linenumber) AS source,
        concat(l_orderkey, '-', first_line) AS target, CASE WHEN l_linestatus = 'O' THEN 'GOVERNED_BY' ELSE 'SIGNED_BY' END AS rel_type,
        concat('line ', l_linenumber) AS evidence
    FROM li WHERE l_linenumber <> first_line AND 0.6 + l_tax * 5 >= 0.7),
edges AS (
    SELECT raw.contract_id, a.canonical_id AS src, b.canonical_id AS dst, rel_type, (list(evidence ORDER BY chunk_index, evidence))[1] AS evidence
    FROM raw JOIN ids a ON a.contract_id = raw.contract_id AND a.id = raw.source JOIN ids b ON b.contract_id = raw.contract_id AND b.id = raw.target
    GROUP BY 1, 2, 3, 4)"""


@R.query("md_silver_entities", "I-11 I-12 DML-04 A-31", f"WITH {STAGED} SELECT contract_id, label, norm, CAST(round(CAST(max(confidence) AS DECIMAL(38,12)), 6) AS DOUBLE) AS confidence, array_to_string(list_sort(list_distinct(list(chunk_index))), ',') AS chunks, count(*) AS n FROM s GROUP BY 1, 2, 3")
def _(spark, d):
    c = canonical_entities(stage_entities(_bronze(spark, d)))
    return c.select("contract_id", "label", "norm", decimal("confidence", 6).alias("confidence"), F.array_join(F.col("source_chunk_indices").cast("array<string>"), ",").alias("chunks"), F.col("evidence_count").alias("n"))


@R.query("md_resolution", "J-25", f"WITH {STAGED}, {IDS} SELECT * FROM ids")
def _(spark, d):
    s = stage_entities(_bronze(spark, d))
    return resolve(s, canonical_entities(s))



_RULES = ", ".join(f"('{a}', '{b}', '{c}', '{t}')" for a, b, c, t in RISK_RULES)
RISK_SQL = f"{STAGED}, held AS MATERIALIZED (SELECT contract_id, list(label) AS ls FROM s GROUP BY 1 HAVING list_contains(list(label), 'Party')), r AS MATERIALIZED (SELECT contract_id AS document_id, risk, severity, risk_type FROM held, (VALUES {_RULES}) q(risk, needed, severity, risk_type) WHERE NOT list_contains(ls, needed))"


def _gold_vertices(spark, d) -> DataFrame:
    c = canonical_entities(stage_entities(_bronze(spark, d)))
    return c.select(F.col("contract_id").alias("document_id"), "label", F.col("canonical_id").alias("uuid"))


@R.query("md_risks", "I-15 J-24", f"WITH {RISK_SQL} SELECT * FROM r")
def _(spark, d):
    return risks(_gold_vertices(spark, d))[0]


_NEED = {risk: label for risk, label, *_ in RISK_RULES}
_PAIRS = ", ".join(f"('{a}', '{b}', '{_NEED[a]}', '{_NEED[b]}')" for a, b in CAUSES)


@R.query("md_risk_causes", "I-15", f"WITH {STAGED}, held AS MATERIALIZED (SELECT contract_id, list(DISTINCT label) AS ls FROM s GROUP BY 1 HAVING bool_or(label = 'Party')) SELECT contract_id AS document_id, cause, effect FROM held, (VALUES {_PAIRS}) q(cause, effect, a, b) WHERE NOT list_contains(ls, a) AND NOT list_contains(ls, b)")
def _(spark, d):
    return risks(_gold_vertices(spark, d))[2]


GOLD_SQL = f"""WITH {STAGED}, {IDS}, {EDGES}
SELECT 'vertex' AS kind, md5(concat_ws('|', contract_id, label, norm)) AS uuid, label AS type, concat('  Part ', substr(norm, 6)) AS name,
    CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dst, contract_id AS document_id, concat('{{"evidence_count":', count(*), '}}') AS properties
FROM s GROUP BY contract_id, label, norm
UNION ALL
SELECT 'edge', md5(concat_ws('|', src, dst, rel_type, contract_id)), rel_type, NULL, src, dst, contract_id, concat('{{"evidence":"', evidence, '"}}') FROM edges"""


@R.query("md_gold_projection", "I-13 I-14 I-16", GOLD_SQL)
def _(spark, d):
    b = _bronze(spark, d)
    s = stage_entities(b)
    c = canonical_entities(s)
    v, e = gold(c, canonical_relations(b, resolve(s, c)))
    count = F.to_json(F.struct(F.get_json_object("metadata", "$.evidence_count").cast("long").alias("evidence_count")))
    v = v.select(F.lit("vertex").alias("kind"), "uuid", F.col("label").alias("type"), "name", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), "document_id", count.alias("properties"))
    return v.unionByName(e.select(F.lit("edge").alias("kind"), "uuid", F.col("rel_type").alias("type"), F.lit(None).cast("string").alias("name"), "src", "dst", "document_id", "properties"))


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
