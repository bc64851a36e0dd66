"""Property graph over two DataFrames: vertices (uuid, label, name, normalized_name, document_id, metadata) and edges
(uuid, src, dst, rel_type, document_id, properties). Patterns are joins; results that a limit cuts are ordered by
source, target and edge, so they are the same every time."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize
from ..plans.registry import Registry, run_sql
from ..session import table
from .merge import upsert
from .rewrites import top_per_group

R = Registry()

# Vertex labels, relationship types, annotation question types and the missing-clause rules of the model.
LABELS = "Contract Section Clause Party Jurisdiction EffectiveDate ExpirationDate RenewalTerm LiabilityClause IndemnityClause PaymentTerm ConfidentialityClause TerminationClause GoverningLawClause Obligation Risk Amendment ReferenceDocument".split()
REL_TYPES = "PARTY_TO SIGNED_BY GOVERNED_BY GOVERNED_BY_LAW INDEMNIFIES HAS_TERMINATION HAS_RENEWAL HAS_PAYMENT_TERM HAS_LICENSE HAS_RESTRICTION HAS_IP_CLAUSE HAS_LIABILITY HAS_PAYMENT HAS_OBLIGATION HAS_CLAUSE HAS_DATE EFFECTIVE_ON EXPIRES_ON OBLIGATES LIMITS_LIABILITY DISCLOSES_TO GRANTS_LICENSE_TO OWES_OBLIGATION_TO ASSIGNS_IP_TO CAN_TERMINATE HAS_SECTION HAS_CHUNK REFERENCES AMENDS SUPERCEDES REPLACES ATTACHES INCORPORATES_BY_REFERENCE INCREASES_RISK_FOR CAUSES".split()
QUESTION_LABELS = {
    "Party": ["Parties"],
    "Jurisdiction": ["Governing Law"],
    "Date": ["Agreement Date", "Effective Date", "Expiration Date", "Renewal Term"],
    "LicenseClause": ["License Grant", "Non-Transferable License", "Irrevocable or Perpetual License", "Unlimited/All-You-Can-Eat License", "Affiliate License-Licensor", "Affiliate License-Licensee"],
    "TerminationClause": ["Termination for Convenience", "Termination for Cause"],
    "RestrictionClause": ["Non-Compete", "No-Solicit of Customers", "No-Solicit of Employees", "Exclusivity", "Competitive Restriction Exception"],
    "IPClause": ["IP Ownership Assignment", "Joint IP Ownership", "Source Code Escrow"],
    "LiabilityClause": ["Cap on Liability", "Uncapped Liability", "Liquidated Damages"],
    "Clause": ["Change of Control", "Anti-Assignment", "Revenue/Profit Sharing", "Price Restrictions", "Minimum Commitment", "Volume Restriction", "Post-Termination Services", "Audit Rights", "Warranty Duration", "Insurance", "Covenant Not to Sue", "Third Party Beneficiary", "Most Favored Nation", "Non-Disparagement", "Notice Period to Terminate Renewal"],
}
LABEL_RELS = {"Party": "PARTY_TO", "Jurisdiction": "GOVERNED_BY_LAW", "Date": "HAS_DATE", "LicenseClause": "HAS_LICENSE", "TerminationClause": "HAS_TERMINATION", "RestrictionClause": "HAS_RESTRICTION", "IPClause": "HAS_IP_CLAUSE", "LiabilityClause": "HAS_LIABILITY", "Clause": "HAS_CLAUSE", "Contract": "HAS_CLAUSE"}


@dataclass(frozen=True)
class Pattern:
    """(src:label)-[rel]->(dst:label); the name filters src, or either side; absent: contracts without such an edge."""

    src: str
    rel: str | None = None
    dst: str | None = None
    either: bool = False
    absent: bool = False
    named: int = 20
    most: int = 50
    use_name: bool = True


#: G-01 to G-24 by intent.
INTENTS = {
    "find_parties": Pattern("Contract", "SIGNED_BY", "Party"),
    "find_indemnification": Pattern("Party", "INDEMNIFIES", "Party", either=True),
    "find_jurisdictions": Pattern("Contract", "GOVERNED_BY", "Jurisdiction"),
    "find_termination_clauses": Pattern("Contract", "HAS_TERMINATION", "TerminationClause"),
    "find_confidentiality_clauses": Pattern("Contract", "HAS_CLAUSE", "ConfidentialityClause"),
    "find_payment_terms": Pattern("Contract", "HAS_PAYMENT_TERM", "PaymentTerm"),
    "find_obligations": Pattern("Contract", "OBLIGATES", "Obligation"),
    "find_liability_clauses": Pattern("Contract", "LIMITS_LIABILITY", "LiabilityClause"),
    "find_effective_dates": Pattern("Contract", "HAS_CLAUSE", "EffectiveDate"),
    "find_expiration_dates": Pattern("Contract", "HAS_CLAUSE", "ExpirationDate"),
    "find_renewal_terms": Pattern("Contract", "HAS_RENEWAL", "RenewalTerm"),
    "find_disclosures": Pattern("Party", "DISCLOSES_TO", "Party"),
    "find_superseded_contracts": Pattern("Contract", "SUPERCEDES", "Contract"),
    "find_amendments": Pattern("Contract", "AMENDS", "Contract"),
    "find_references": Pattern("Contract", "REFERENCES", "ReferenceDocument"),
    "find_incorporated_documents": Pattern("Contract", "INCORPORATES_BY_REFERENCE", "ReferenceDocument"),
    "find_attachments": Pattern("Contract", "ATTACHES", "ReferenceDocument"),
    "find_replacements": Pattern("Contract", "REPLACES", "Contract"),
    "find_all_risks": Pattern("Risk", "INCREASES_RISK_FOR", "Party", either=True),
    "find_risk_chains": Pattern("Risk", "CAUSES", "Risk", use_name=False),
    "find_missing_indemnity": Pattern("Contract", "HAS_CLAUSE", "IndemnityClause", absent=True),
    "find_missing_termination": Pattern("Contract", "HAS_TERMINATION", "TerminationClause", absent=True),
    "find_sections": Pattern("Contract", "HAS_SECTION", "Section", named=50),
    "list_contracts": Pattern("Contract"),
}

#: Own example questions of each intent. What an intent is about is read from its name, from the labels and the relation of
#: its pattern, and from these.
EXAMPLES = {
    "find_parties": ["Who signed this deal?", "Name the party on each side"],
    "find_indemnification": ["Who indemnifies whom?", "Does anybody hold us harmless?"],
    "find_jurisdictions": ["Courts of which country decide?"],
    "find_termination_clauses": ["How can we terminate it early?"],
    "find_confidentiality_clauses": ["What must be kept secret?"],
    "find_payment_terms": ["What fees and prices are to be paid?"],
    "find_obligations": ["What must the supplier deliver, what is it obliged to do?"],
    "find_liability_clauses": ["Is damage liable to a cap?"],
    "find_effective_dates": ["From when is it effective and in force?"],
    "find_expiration_dates": ["When does it expire or end?"],
    "find_renewal_terms": ["Can it be renewed or prolonged?"],
    "find_disclosures": ["Who discloses data to whom?"],
    "find_superseded_contracts": ["Which deal is superseded by it?"],
    "find_amendments": ["Which deal was amended or changed?"],
    "find_references": ["Which papers are referenced or cited?"],
    "find_incorporated_documents": ["Which papers are incorporated?"],
    "find_attachments": ["Which annexes are attached?"],
    "find_replacements": ["Which deal did it replace?"],
    "find_all_risks": ["How risky is it, what could harm a party?"],
    "find_risk_chains": ["Which risk brings about which?"],
    "find_missing_indemnity": ["Which ones lack an indemnity?", "Those without indemnity"],
    "find_missing_termination": ["Which ones lack termination?", "Those without termination"],
    "find_sections": ["What headings and chapters does it have?"],
}
#: GS-10: the intents of the logical graphs beside ENTITY, which is always asked.
GRAPHS = {
    "HIERARCHY": ["find_sections"],
    "LINEAGE": ["find_superseded_contracts", "find_amendments", "find_references", "find_incorporated_documents", "find_attachments", "find_replacements"],
    "RISK": ["find_all_risks", "find_risk_chains"],
}
#: Words of names and patterns that tell nothing apart.
COMMON = frozenset("find all contract contracts agreement clause clauses document documents deal term terms date dates has by for to on from other each it its we us be this those ones side could must kept did".split())
#: Words that begin questions and sentences, and words that are no name by themselves.
OPENERS = frozenset("which what who whose whom how when where why is are was were do does did has have can could will list show find give tell name in on at of for the a an any all".split())


def stems(text: str) -> set[str]:
    """The first five letters of words, of the singular of those in -ies and -s; names in capitals and lines fall apart."""
    words = re.findall(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+", text)
    words = [w.lower() for w in words if w.lower() not in OPENERS and w.lower() not in COMMON]
    return {(w[:-3] + "y" if w.endswith("ies") else w[:-1] if w.endswith("s") and len(w) > 3 else w)[:5] for w in words}


def _weights() -> dict[str, dict[str, float]]:
    """By intent, what its stems weigh: more the fewer intents have them, twice if they are in its name."""
    own = {}
    for intent, examples in EXAMPLES.items():
        p = INTENTS[intent]
        own[intent] = (stems(intent), stems(" ".join([p.src, p.rel or "", "" if p.absent else p.dst or "", *examples])))
    spread = Counter(x for name, rest in own.values() for x in name | rest)
    return {k: {x: (2 if x in name else 1) * math.log((1 + len(own)) / spread[x]) for x in name | rest} for k, (name, rest) in own.items()}


WEIGHTS = _weights()


def name_in(question: str) -> str | None:
    """What stands in quotes that open after a space; else the longest run of capitalised words that does not just open
    the sentence, the first of equals."""
    for mark in "\"'":
        parts = f" {question} ".split(f" {mark}", 1)
        if len(parts) == 2 and (inner := parts[1].partition(mark)[0].strip()) and mark in parts[1]:
            return inner
    runs, run, begun = [], [], 0
    for k, token in enumerate([*question.split(), ""]):
        bare = token.strip(".,;:!?()")
        goes_on = bare[:1].isupper() and (run or bare.lower() not in OPENERS) or run and bare == "&"
        if goes_on:
            begun = begun if run else k
            run.append(bare.removesuffix("'s"))
        if run and (not goes_on or token[-1:] in tuple(",;:!?")):
            runs.append((begun, run))
            run = []
    names = [" ".join(r) for k, r in runs if (k or len(r) > 1) and (len(r) > 1 or len(r[0]) > 4 or not r[0].isupper())]
    return max(names, key=lambda r: len(r.split()), default=None)


def parse_intent(question: str) -> tuple[str, str | None]:
    """(intent, name) of a question: the intent whose stems in the question (without the name) weigh most, of equals the
    first; list_contracts if it has none."""
    name = name_in(question)
    asked = stems(question.replace(name, " ") if name else question)
    scores = {intent: sum(own[x] for x in sorted(asked & own.keys())) for intent, own in WEIGHTS.items()}
    best = max(scores, key=scores.get)
    return (best if scores[best] else "list_contracts"), name


def route(question: str) -> list[str]:
    """The logical graphs to ask, ENTITY always, in order: those that a stem of the question belongs to and no intent outside."""
    asked = stems(question)
    out = ["ENTITY"]
    for graph, intents in GRAPHS.items():
        outside = {x for k, own in WEIGHTS.items() if k not in intents for x in own}
        if any(x in WEIGHTS[k] and x not in outside for x in asked for k in intents):
            out.append(graph)
    return out


def match(v: DataFrame, e: DataFrame, src: str | list | None = None, rel: str | list | None = None, dst: str | list | None = None) -> DataFrame:
    """J-22, GP-03 to GP-05: directed edges with their ends: columns a_*, r_*, b_*; each part may be open or a list."""

    def among(df: DataFrame, c: str, x) -> DataFrame:
        return df if x is None else df.where(F.col(c).isin(x if isinstance(x, list) else [x]))

    a = among(v, "label", src).select(*[F.col(c).alias(f"a_{c}") for c in v.columns])
    b = among(v, "label", dst).select(*[F.col(c).alias(f"b_{c}") for c in v.columns])
    r = among(e, "rel_type", rel).select(*[F.col(c).alias(f"r_{c}") for c in e.columns])
    return r.join(a, F.col("r_src") == F.col("a_uuid")).join(b, F.col("r_dst") == F.col("b_uuid"))


def match_any_way(v: DataFrame, e: DataFrame, **parts) -> DataFrame:
    """J-23: undirected: edges and their reverse; self loops once."""
    back = e.where("src <> dst").withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return match(v, e.unionByName(back), **parts)


def absent(v: DataFrame, e: DataFrame, src: str, rel: str, dst: str) -> DataFrame:
    """J-24: vertices of a label without such an edge."""
    has = match(v, e, src, rel, dst).select(F.col("a_uuid").alias("uuid"))
    return v.where(F.col("label") == src).join(has, "uuid", "left_anti")


def optional_match(v: DataFrame, e: DataFrame, src: str, rel: str, dst: str) -> DataFrame:
    """GP-06: vertices of a label with their targets, null where there is none."""
    got = match(v, e, src, rel, dst).select(F.col("a_uuid").alias("_u"), F.col("b_uuid").alias("target"), F.col("b_name").alias("target_name"))
    own = v.where(F.col("label") == src)
    return own.join(got, own["uuid"] == got["_u"], "left").drop("_u")


def paths(e: DataFrame, rel: str | list, least: int = 1, most: int = 3) -> DataFrame:
    """GP-01, GP-02: (start, end, depth, nodes) of directed paths that use no edge twice, one join per hop."""
    r = e.where(F.col("rel_type").isin(rel if isinstance(rel, list) else [rel])).select(F.col("uuid").alias("_e"), F.col("src").alias("_s"), F.col("dst").alias("_d"))
    now = r.select(F.col("_s").alias("start"), F.col("_d").alias("end"), F.lit(1).alias("depth"), F.array("_s", "_d").alias("nodes"), F.array("_e").alias("used"))
    every = now
    for k in range(2, most + 1):
        now = now.join(r, (F.col("end") == F.col("_s")) & ~F.array_contains("used", F.col("_e")))
        now = now.select("start", F.col("_d").alias("end"), F.lit(k).alias("depth"), F.array_append("nodes", F.col("_d")).alias("nodes"), F.array_append("used", F.col("_e")).alias("used"))
        every = every.unionByName(now)
    return every.where(F.col("depth") >= least).drop("used")


def run_intent(v: DataFrame, e: DataFrame, intent: str, name: str | None = None, bundles: tuple[Bundle, ...] = ()) -> DataFrame:
    """G-01 to G-24: (source, target, rel_type, detail), at most 20 rows for a name, else 50; bundles: more edges of the
    pattern's type."""
    p = INTENTS[intent]
    name = name if p.use_name else None
    most = p.named if name else p.most
    if p.rel is None or p.absent:
        d = absent(v, e, p.src, p.rel, p.dst) if p.absent else v.where(F.col("label") == p.src)
        d = d.select(F.col("name").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(p.rel).alias("rel_type"), F.col("metadata").alias("detail"))
    else:
        d = match(v, e, p.src, p.rel, p.dst).select(F.col("a_name").alias("source"), F.col("b_name").alias("target"), F.col("r_rel_type").alias("rel_type"), F.col("a_metadata").alias("detail"))
    if name:
        hit = F.contains("source", F.lit(name))
        d = d.where(hit | F.coalesce(F.contains("target", F.lit(name)), F.lit(False)) if p.either else hit)
    for b in bundles:
        order = [F.asc("a_name"), F.asc("b_name"), F.asc("a_metadata")]
        a, t = b.ends(v, p.src, p.dst)
        of_a, of_b = (F.contains(c, F.lit(name)) if name else F.lit(True) for c in ("a_name", "b_name"))
        pairs = first_pairs_where(a, t, of_a, of_b, order, most) if p.either else first_pairs(a.where(of_a), t, order, most)
        d = d.unionByName(pairs.select(F.col("a_name").alias("source"), F.col("b_name").alias("target"), F.lit(b.rel_type).alias("rel_type"), F.col("a_metadata").alias("detail")))
    return d.orderBy("source", "target", "detail").limit(most)


def answer(v: DataFrame, e: DataFrame, question: str) -> DataFrame:
    return run_intent(v, e, *parse_intent(question))


@dataclass(frozen=True)
class Bundle:
    """The edges of a type from every source (group, src) to every target (group, dst) of its group, by their ends: as edges
    they are as many as the product of the two."""

    rel_type: str
    sources: DataFrame
    targets: DataFrame

    def count(self) -> DataFrame:
        """(k, n): the type and how many edges; no row if there are none."""
        s, t = (df.groupBy("group").agg(F.count("*").alias(n)) for df, n in ((self.sources, "s"), (self.targets, "t")))
        return s.join(t, "group").agg(F.sum(F.col("s") * F.col("t")).alias("n")).where("n > 0").select(F.lit(self.rel_type).alias("k"), "n")

    def ends(self, v: DataFrame, src: str | None = None, dst: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Sources with columns a_*, targets with columns b_*, of these labels."""
        out = []
        for df, end, label, x in ((self.sources, "src", src, "a_"), (self.targets, "dst", dst, "b_")):
            own = v if label is None else v.where(F.col("label") == label)
            own = own.select(*[F.col(c).alias(x + c) for c in v.columns])
            out.append(df.join(own, F.col(end) == F.col(f"{x}uuid")).drop(end))
        return out[0], out[1]


def first_pairs(sources: DataFrame, targets: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n first of all pairs of a source and a target of one group. The order must be, for one source, that of b_name, and
    what is read of a pair must follow from it. Only each group's n first targets can be among the pairs, and only the n
    sources that are first with their group's first target: every pair of another source has n before it."""
    best = top_per_group(targets, ["group"], [F.asc("b_name")], n)
    leading = sources.join(best.where("rn = 1").drop("rn"), "group").orderBy(*order).limit(n).select(*sources.columns)
    return leading.join(best.drop("rn"), "group").orderBy(*order).limit(n)


def first_pairs_where(sources: DataFrame, targets: DataFrame, a: Column, b: Column, order: list[Column], n: int) -> DataFrame:
    """The same of the pairs where the condition of the source or that of the target holds, as two products of which one at most
    has a pair."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return first_pairs(sources.where(a), targets, order, n).unionByName(first_pairs(sources.where(~a), targets.where(b), order, n))


class GraphStore:
    """GS-01 to GS-08 over the two tables; each change gives a new store. Edges may also be known as bundles: then plain are
    those of no bundle."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, plain: DataFrame | None = None, bundles: tuple[Bundle, ...] = ()):
        self.v, self.e, self.plain, self.bundles = vertices, edges, edges if plain is None else plain, bundles

    def ask(self, intent: str, name: str | None = None) -> DataFrame:
        """G-01 to G-24: run_intent, of bundles only by pairs that are among its first."""
        p = INTENTS[intent]
        if p.rel is None or p.absent:
            return run_intent(self.v, self.e, intent, name)
        return run_intent(self.v, self.plain, intent, name, tuple(b for b in self.bundles if b.rel_type == p.rel))

    def merge_vertices(self, new: DataFrame) -> GraphStore:
        """Same label, normalised name and document keep their uuid; name and metadata are overwritten; unknown labels
        become Clause."""
        keys = ["label", "normalized_name", "document_id"]
        n = new.withColumn("label", F.when(F.col("label").isin(LABELS), F.col("label")).otherwise("Clause")).withColumn("normalized_name", normalize(F.col("name")))
        n = n.dropDuplicates(keys).join(self.v.select(*keys, F.col("uuid").alias("_old")), keys, "left")
        n = n.withColumn("uuid", F.coalesce("_old", "uuid")).select(*self.v.columns)
        return GraphStore(upsert(self.v, n, keys), self.e)

    def add_edges(self, new: DataFrame, once: bool = True) -> GraphStore:
        """GS-02, GP-09: unknown types become HAS_CLAUSE; once: an edge that is there is not added again."""
        n = new.withColumn("rel_type", F.when(F.col("rel_type").isin(REL_TYPES), F.col("rel_type")).otherwise("HAS_CLAUSE")).select(*self.e.columns)
        if once:
            keys = ["src", "dst", "rel_type", "document_id"]
            n = n.dropDuplicates(keys).join(self.e.select(*keys), keys, "left_anti").select(*self.e.columns)
        return GraphStore(self.v, self.e.unionByName(n))

    def detach_delete(self, where: Column) -> GraphStore:
        """Vertices that meet the condition and their edges go (a document: document_id == x, over all labels)."""
        gone = self.v.where(where).select("uuid")
        e = self.e.join(gone.withColumnRenamed("uuid", "src"), "src", "left_anti").join(gone.withColumnRenamed("uuid", "dst"), "dst", "left_anti")
        return GraphStore(self.v.join(gone, "uuid", "left_anti"), e.select(*self.e.columns))

    def set_property(self, where: Column, **values) -> GraphStore:
        return GraphStore(self.v.withColumns({k: F.when(where, F.lit(x)).otherwise(F.col(k) if k in self.v.columns else F.lit(None)) for k, x in values.items()}), self.e)

    def search(self, text: str, n: int = 10) -> DataFrame:
        return self.v.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("name", "uuid").limit(n)

    def related(self, uuid: str, rel: str | None = None) -> DataFrame:
        rel = rel if rel is None or rel in REL_TYPES else "HAS_CLAUSE"
        return match_any_way(self.v, self.e, rel=rel).where(F.col("a_uuid") == uuid).select(F.col("r_rel_type").alias("rel_type"), F.col("b_uuid").alias("uuid"), F.col("b_name").alias("name"), F.col("b_label").alias("label")).distinct()

    def contracts_of(self, name: str) -> DataFrame:
        return match(self.v, self.e, dst="Contract").where(F.contains(F.lower("a_name"), F.lit(name.lower()))).select(F.col("b_uuid").alias("uuid"), F.col("b_name").alias("name")).distinct()

    def context(self, text: str, n: int = 20) -> DataFrame:
        a, b = (F.contains(F.lower(c), F.lit(text.lower())) for c in ("a_name", "b_name"))
        d = match(self.v, self.plain).where(a | b).select(F.concat_ws(" ", "a_name", "r_rel_type", "b_name").alias("line"))
        for x in self.bundles:
            line = F.concat_ws(" ", "a_name", F.lit(x.rel_type), "b_name")
            d = d.unionByName(first_pairs_where(*x.ends(self.v), a, b, [line.asc()], n).select(line.alias("line")))
        return d.orderBy("line").limit(n)

    def stats(self) -> DataFrame:
        a = self.v.groupBy(F.col("label").alias("k")).agg(F.count("*").alias("n")).withColumn("part", F.lit("vertex"))
        e = self.plain.groupBy(F.col("rel_type").alias("k")).agg(F.count("*").alias("n"))
        for b in self.bundles:
            e = e.unionByName(b.count())
        e = e.groupBy("k").agg(F.sum("n").alias("n")) if self.bundles else e
        return a.unionByName(e.withColumn("part", F.lit("edge")))

    _MATCH = re.compile(r"\s*MATCH\s*\((\w*)(?::(\w+))?\)\s*(<?)-\[(\w*)(?::([\w|]+))?\]-(>?)\s*\((\w*)(?::(\w+))?\)\s*(?:WHERE\s+(.*?))?\s*RETURN\s+(.*?)(?:\s+LIMIT\s+(\d+))?\s*;?\s*$", re.I | re.S)
    _COND = re.compile(r"(toLower\()?(\w+)\.(\w+)\)?\s*(=|<>|<=|>=|<|>|CONTAINS|STARTS WITH)\s*(?:'([^']*)'|(-?[\d.]+))", re.I)

    def cypher(self, text: str) -> DataFrame:
        """GS-08: one MATCH of one edge, WHERE of comparisons joined by AND or OR, RETURN of properties, LIMIT."""
        if re.search(r"\b(CREATE|MERGE|DELETE|SET|REMOVE|DROP|DETACH)\b", re.sub(r"'[^']*'", "", text), re.I):
            raise ValueError("only reading is allowed")
        m = self._MATCH.match(text)
        if not m:
            raise ValueError("not a supported pattern")
        a, la, left, r, rels, right, b, lb, where, ret, limit = m.groups()
        if left:
            a, la, b, lb = b, lb, a, la
        f = match if left or right else match_any_way
        df = f(self.v, self.e, src=la, rel=rels.split("|") if rels else None, dst=lb)
        side = {a: "a_", r: "r_", b: "b_"}
        if where:
            total = None
            for part in re.split(r"\s+OR\s+", where, flags=re.I):
                every = None
                for c in re.split(r"\s+AND\s+", part, flags=re.I):
                    x = self._COND.fullmatch(c.strip(" ()") if not c.strip().lower().startswith("tolower") else c.strip())
                    if not x:
                        raise ValueError(f"not a supported condition: {c}")
                    col = F.col(side[x[2]] + x[3])
                    col, v = F.lower(col) if x[1] else col, F.lit(x[5] if x[5] is not None else float(x[6]))
                    one = {"=": col == v, "<>": col != v, "<": col < v, ">": col > v, "<=": col <= v, ">=": col >= v, "CONTAINS": F.contains(col, v), "STARTS WITH": F.startswith(col, v)}[x[4].upper()]
                    every = one if every is None else every & one
                total = every if total is None else total | every
            df = df.where(total)
        out = []
        for item in ret.split(","):
            x = re.fullmatch(r"\s*(?:(\w+)\.(\w+)|type\((\w+)\))(?:\s+AS\s+(\w+))?\s*", item, re.I)
            if not x:
                raise ValueError(f"not a supported result: {item}")
            out.append(F.col(f"{side[x[1]]}{x[2]}" if x[1] else f"{side[x[3]]}rel_type").alias(x[4] or x[2] or "type"))
        df = df.select(*out)
        return df.orderBy(*df.columns).limit(int(limit)) if limit else df


def cypher_of(nodes: list[dict], edges: list[dict]) -> list[str]:
    """GS-11: statements that make a graph document."""
    q = lambda s: str(s).replace("\\", "\\\\").replace("'", "\\'")
    out = [f"MERGE (n:{n['label']} {{id: '{q(n['id'])}'}}) SET n.name = '{q(n.get('name', n['id']))}'" for n in nodes]
    return out + [f"MATCH (a {{id: '{q(e['src'])}'}}), (b {{id: '{q(e['dst'])}'}}) MERGE (a)-[:{e['rel_type']}]->(b)" for e in edges]


def valid_at(e: DataFrame, at: Column) -> DataFrame:
    """GS-12: edges whose valid time (valid_from, valid_to; open if null) holds the moment."""
    return e.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


# the star schema as a graph: customers are contracts, suppliers parties, nations jurisdictions; parts are the other
# vertices, of 13 labels in turn, and a contract has an edge to the next part of each label, but for every seventh contract
_K = "((l.k - c_custkey) % 13 + 13) % 13"
V_SQL = """l AS (SELECT * FROM (VALUES (0, 'Section', 'HAS_SECTION'), (1, 'Clause', 'HAS_CLAUSE'), (2, 'TerminationClause', 'HAS_TERMINATION'),
    (3, 'ConfidentialityClause', 'HAS_CLAUSE'), (4, 'PaymentTerm', 'HAS_PAYMENT_TERM'), (5, 'Obligation', 'OBLIGATES'), (6, 'LiabilityClause', 'LIMITS_LIABILITY'),
    (7, 'EffectiveDate', 'HAS_CLAUSE'), (8, 'ExpirationDate', 'HAS_CLAUSE'), (9, 'RenewalTerm', 'HAS_RENEWAL'), (10, 'ReferenceDocument', 'REFERENCES'),
    (11, 'IndemnityClause', 'HAS_CLAUSE'), (12, 'Risk', NULL)) AS t(k, label, rel)),
v AS (SELECT concat('c', CAST(c_custkey AS STRING)) AS uuid, 'Contract' AS label, c_name AS name FROM customer
    UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 'Party', s_name FROM supplier
    UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), 'Jurisdiction', n_name FROM nation
    UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), l.label, p_name FROM part JOIN l ON l.k = p_partkey % 13)"""


def _edge(kind: str, key: str, src: str, dst: str, rel: str, rest: str) -> str:
    return f"SELECT concat('{kind}', CAST({key} AS STRING)) AS uuid, concat({src}) AS src, concat({dst}) AS dst, {rel} AS rel_type FROM {rest}"


_C, _D, _S, _P = (f"'{x}', CAST({y} AS STRING)" for x, y in (("c", "c_custkey"), ("c", "c_custkey + {0}"), ("s", "s_suppkey"), ("p", "p_partkey")))
_NEXT = "customer WHERE c_custkey % {1} {2} 0 AND c_custkey + {0} IN (SELECT c_custkey FROM customer)"
_MORE = "supplier WHERE s_suppkey + {0} IN (SELECT s_suppkey FROM supplier)"
_PARTS = "part WHERE p_partkey % 13 = {0} AND p_partkey + {1} IN (SELECT p_partkey FROM part)"
_SIGNED = f"SELECT concat('b', CAST(c_custkey AS STRING), '-', CAST(s_suppkey AS STRING)), concat({_C}), concat({_S}), 'SIGNED_BY' FROM customer JOIN supplier ON c_nationkey = s_nationkey"
_EDGES = [
    _edge("g", "c_custkey", _C, "'n', CAST(c_nationkey AS STRING)", "'GOVERNED_BY'", "customer WHERE c_custkey % 3 <> 0"),
    _SIGNED,
    _edge("a", "c_custkey", _C, _D.format(1), "'AMENDS'", _NEXT.format(1, 5, "<>")),
    _edge("u", "c_custkey", _C, _D.format(2), "'SUPERCEDES'", _NEXT.format(2, 3, "=")),
    _edge("r", "c_custkey", _C, _D.format(3), "'REPLACES'", _NEXT.format(3, 4, "=")),
    _edge("i", "s_suppkey", _S, "'s', CAST(s_suppkey + 1 AS STRING)", "'INDEMNIFIES'", _MORE.format(1)),
    _edge("d", "s_suppkey", _S, "'s', CAST(s_suppkey + 2 AS STRING)", "'DISCLOSES_TO'", _MORE.format(2)),
    f"SELECT concat('h', CAST(c_custkey AS STRING), '-', CAST(l.k AS STRING)), concat({_C}), concat({_P}), CASE WHEN l.k <> 10 THEN l.rel WHEN c_custkey % 3 = 0 THEN 'REFERENCES' WHEN c_custkey % 3 = 1 THEN 'INCORPORATES_BY_REFERENCE' ELSE 'ATTACHES' END FROM customer JOIN l ON l.k < 12 JOIN part ON p_partkey = c_custkey + {_K} WHERE c_custkey % 7 <> 0",
    _edge("k", "p_partkey", _P, "'p', CAST(p_partkey + 1 AS STRING)", "'HAS_CLAUSE'", _PARTS.format(0, 1)),
    _edge("o", "p_partkey", _P, "'p', CAST(p_partkey + 13 AS STRING)", "'CAUSES'", _PARTS.format(12, 13)),
    f"SELECT concat('w', CAST(p_partkey AS STRING)), concat({_P}), concat({_S}), 'INCREASES_RISK_FOR' FROM part JOIN supplier ON s_suppkey = p_partkey % 10 + 1 WHERE p_partkey % 13 = 12",
]
E_SQL = "e AS (" + "\nUNION ALL ".join(_EDGES) + ")"
#: The edges less those between all customers and suppliers of a nation, which are a bundle.
PLAIN_SQL = "e AS (" + "\nUNION ALL ".join(x for x in _EDGES if x is not _SIGNED) + ")"


def star_graph(spark, d) -> GraphStore:
    v = run_sql(spark, d, f"WITH {V_SQL} SELECT * FROM v").withColumns({"normalized_name": normalize(F.col("name")), "document_id": F.lit("star"), "metadata": F.lit("{}")})
    every, plain = (run_sql(spark, d, f"WITH {V_SQL}, {e} SELECT * FROM e").withColumns({"document_id": F.lit("star"), "properties": F.lit("{}")}) for e in (E_SQL, PLAIN_SQL))
    signed = [table(spark, d, t).select(F.col(g).alias("group"), F.concat(F.lit(x), F.col(k).cast("string")).alias(end)) for t, g, x, k, end in (("customer", "c_nationkey", "c", "c_custkey", "src"), ("supplier", "s_nationkey", "s", "s_suppkey", "dst"))]
    return GraphStore(v, every, plain, (Bundle("SIGNED_BY", *signed),))


def _intent_sql(p: Pattern, name: str | None) -> str:
    if p.absent or p.rel is None:
        cond = f" AND NOT EXISTS (SELECT 1 FROM e JOIN v t ON t.uuid = e.dst WHERE e.src = v.uuid AND e.rel_type = '{p.rel}' AND t.label = '{p.dst}')" if p.absent else ""
        return f"WITH {V_SQL}, {E_SQL} SELECT name AS source, CAST(NULL AS STRING) AS target FROM v WHERE label = '{p.src}'{cond} ORDER BY name LIMIT 50"
    named = f" AND contains(a.name, '{name}')" if name else ""
    return f"WITH {V_SQL}, {E_SQL} SELECT a.name AS source, b.name AS target FROM e JOIN v a ON a.uuid = e.src JOIN v b ON b.uuid = e.dst WHERE a.label = '{p.src}' AND b.label = '{p.dst}' AND e.rel_type = '{p.rel}'{named} ORDER BY 1, 2 LIMIT {20 if name else 50}"


for _intent, _p in INTENTS.items():
    _name = "1" if _intent in ("find_parties", "find_jurisdictions") else None

    def _run(spark, d, intent=_intent, name=_name):
        return star_graph(spark, d).ask(intent, name).select("source", "target")

    R.query(f"g_{_intent}", "G-" + f"{list(INTENTS).index(_intent) + 1:02d}", _intent_sql(_p, _name))(_run)


@R.query("gp_undirected", "J-23 GS-04 GP-04", f"WITH {V_SQL}, {E_SQL}, u AS (SELECT src, dst, rel_type FROM e UNION ALL SELECT dst, src, rel_type FROM e WHERE src <> dst) SELECT DISTINCT b.uuid, b.label, u.rel_type FROM u JOIN v b ON b.uuid = u.dst WHERE u.src = 'c7'")
def _(spark, d):
    return star_graph(spark, d).related("c7").select("uuid", "label", "rel_type")


@R.query("gp_optional", "GP-06 J-24", f"WITH {V_SQL}, {E_SQL} SELECT v.uuid, t.uuid AS target FROM v LEFT JOIN (e JOIN v t ON t.uuid = e.dst AND e.rel_type = 'GOVERNED_BY' AND t.label = 'Jurisdiction') ON e.src = v.uuid WHERE v.label = 'Contract'")
def _(spark, d):
    g = star_graph(spark, d)
    return optional_match(g.v, g.e, "Contract", "GOVERNED_BY", "Jurisdiction").select("uuid", "target")


@R.query("gp_two_hops", "GP-01 J-22", f"WITH {V_SQL}, {E_SQL} SELECT a.uuid AS contract, b.uuid AS section, c.uuid AS clause FROM e x JOIN e y ON y.src = x.dst JOIN v a ON a.uuid = x.src JOIN v b ON b.uuid = x.dst JOIN v c ON c.uuid = y.dst WHERE x.rel_type = 'HAS_SECTION' AND y.rel_type = 'HAS_CLAUSE' AND a.label = 'Contract' AND b.label = 'Section' AND c.label = 'Clause'")
def _(spark, d):
    g = star_graph(spark, d)
    first = match(g.v, g.e, "Contract", "HAS_SECTION", "Section").select(F.col("a_uuid").alias("contract"), F.col("b_uuid").alias("section"))
    return first.join(match(g.v, g.e, "Section", "HAS_CLAUSE", "Clause").select(F.col("a_uuid").alias("section"), F.col("b_uuid").alias("clause")), "section")


@R.query("gp_edge_types", "GP-10", f"WITH {V_SQL}, {E_SQL} SELECT rel_type, count(*) AS n FROM e WHERE rel_type LIKE 'HAS!_%' ESCAPE '!' GROUP BY 1")
def _(spark, d):
    return star_graph(spark, d).e.where("rel_type LIKE 'HAS!_%' ESCAPE '!'").groupBy("rel_type").agg(F.count("*").alias("n"))


@R.query("gs_add_edges", "GS-02 GP-09", f"WITH {V_SQL}, {E_SQL}, g AS (SELECT src, dst FROM e WHERE rel_type = 'GOVERNED_BY') SELECT 'GOVERNED_BY' AS rel_type, 'once' AS how, count(*) AS n FROM g UNION ALL SELECT 'GOVERNED_BY', 'again', 2 * count(*) FROM g UNION ALL SELECT 'HAS_CLAUSE', x, count(*) FROM g, (VALUES ('once'), ('again')) t(x) GROUP BY x")
def _(spark, d):
    g = star_graph(spark, d)
    old = g.e.where("rel_type = 'GOVERNED_BY'")
    new = old.unionByName(old.withColumn("rel_type", F.lit("NO_SUCH_TYPE"))).withColumn("uuid", F.concat(F.lit("x"), "uuid"))
    out = [GraphStore(g.v, old).add_edges(new, once).e.withColumn("how", F.lit(how)) for how, once in (("once", True), ("again", False))]
    return out[0].unionByName(out[1]).groupBy("rel_type", "how").agg(F.count("*").alias("n"))


@R.query("gp_paths", "GP-02", f"WITH RECURSIVE {V_SQL}, {E_SQL}, p AS (SELECT src AS start_, dst AS end_, 1 AS depth, concat(src, '>', dst) AS nodes FROM e WHERE rel_type = 'AMENDS' UNION ALL SELECT p.start_, e.dst, p.depth + 1, concat(p.nodes, '>', e.dst) FROM p JOIN e ON e.src = p.end_ AND e.rel_type = 'AMENDS' WHERE p.depth < 3) SELECT start_, end_, depth, nodes FROM p")
def _(spark, d):
    return paths(star_graph(spark, d).e, "AMENDS", 1, 3).select(F.col("start").alias("start_"), F.col("end").alias("end_"), "depth", F.array_join("nodes", ">").alias("nodes"))


@R.query("gp_alternation", "GP-03 GP-05 GP-07", f"WITH {V_SQL}, {E_SQL} SELECT e.uuid FROM e JOIN v b ON b.uuid = e.dst WHERE e.rel_type IN ('AMENDS', 'GOVERNED_BY') AND b.label IN ('Jurisdiction', 'Contract') AND contains(lower(b.name), '2')")
def _(spark, d):
    g = star_graph(spark, d)
    return match(g.v, g.e, rel=["AMENDS", "GOVERNED_BY"], dst=["Jurisdiction", "Contract"]).where(F.contains(F.lower("b_name"), F.lit("2"))).select(F.col("r_uuid").alias("uuid"))


@R.query("gp_cypher", "GS-08", f"WITH {V_SQL}, {E_SQL} SELECT a.name AS contract, b.name AS law FROM e JOIN v a ON a.uuid = e.src JOIN v b ON b.uuid = e.dst WHERE e.rel_type = 'GOVERNED_BY' AND contains(lower(a.name), '11') ORDER BY 1, 2 LIMIT 30")
def _(spark, d):
    return star_graph(spark, d).cypher("MATCH (c:Contract)-[r:GOVERNED_BY]->(j:Jurisdiction) WHERE toLower(c.name) CONTAINS '11' RETURN c.name AS contract, j.name AS law LIMIT 30")


@R.query("gs_stats", "GS-07 GP-08", f"WITH {V_SQL}, {E_SQL} SELECT label AS k, count(*) AS n, 'vertex' AS part FROM v GROUP BY 1 UNION ALL SELECT rel_type, count(*), 'edge' FROM e GROUP BY 1")
def _(spark, d):
    return star_graph(spark, d).stats()


@R.query("gs_merge_vertices", "GS-01 GP-09", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE k % 2 = 0) AS BIGINT) AS renamed FROM (SELECT c_custkey AS k FROM customer) t")
def _(spark, d):
    g = star_graph(spark, d)
    contracts = g.v.where("label = 'Contract'")
    new = contracts.where("cast(substring(uuid, 2) as long) % 2 = 0").withColumns({"uuid": F.concat(F.lit("x"), "uuid"), "name": F.upper("name"), "metadata": F.lit("new")})
    out = GraphStore(contracts, g.e).merge_vertices(new).v
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("metadata") == "new").alias("renamed"))


@R.query("gs_search_context", "GS-06", f"WITH {V_SQL}, {E_SQL} SELECT concat(a.name, ' ', e.rel_type, ' ', b.name) AS line FROM e JOIN v a ON a.uuid = e.src JOIN v b ON b.uuid = e.dst WHERE contains(lower(a.name), '12') OR contains(lower(b.name), '12') ORDER BY 1 LIMIT 20")
def _(spark, d):
    return star_graph(spark, d).context("12")


#: Questions with the intent, name and graphs that they must give.
#: Questions about a customer by the remainder of the key: (text, intent, whether the name is found, graphs).
ASKED = [
    ("Which parties signed '{}'?", "find_parties", True, "ENTITY"),
    ("Is anyone indemnified under '{}'?", "find_indemnification", True, "ENTITY"),
    ("Which agreements lack an indemnity clause?", "find_missing_indemnity", False, "ENTITY"),
    ("What risk causes another risk?", "find_risk_chains", False, "ENTITY,RISK"),
    ("What does '{}' amend?", "find_amendments", True, "ENTITY,LINEAGE"),
    ("Show the section headings of '{}'", "find_sections", True, "ENTITY,HIERARCHY"),
    ("List everything", "list_contracts", False, "ENTITY"),
]


def _case(values) -> str:
    return "CASE c_custkey % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


QUESTION = _case(f"replace({_text(q)}, '{{}}', c_name)" for q, *_ in ASKED)


def _of_questions(df: DataFrame, schema: str, answer) -> DataFrame:
    """Rows (key, question) with what an answer says of each question, by Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [answer(q) for q in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), *[pa.array([f[k] for f in found], pa.string()) for k in range(len(found[0]) if found else schema.count(" string"))]], names=[x.split()[0] for x in schema.split(", ")])

    return df.mapInArrow(run, schema)


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.expr(QUESTION).alias("question"))


@R.query("gs_intents", "GS-09", f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, {_case(_text(i) for _, i, _, _ in ASKED)} AS intent, {_case('c_name' if n else 'NULL' for _, _, n, _ in ASKED)} AS name FROM customer")
def _(spark, d):
    """Intents and names of a question about each customer."""
    return _of_questions(_questions(spark, d), "c_custkey long, intent string, name string", parse_intent)


@R.query("gs_routes", "GS-10", f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, {_case(_text(g) for *_, g in ASKED)} AS graphs FROM customer")
def _(spark, d):
    """The logical graphs that a question about each customer goes to."""
    return _of_questions(_questions(spark, d), "c_custkey long, graphs string", lambda q: (",".join(route(q)),))


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
