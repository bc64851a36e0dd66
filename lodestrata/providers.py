"""Interfaces of external models, with deterministic offline implementations."""

from __future__ import annotations

import hashlib
import math
import re
from collections import OrderedDict
from typing import Protocol


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class Extractor(Protocol):
    def extract(self, text: str) -> dict: ...


class HashEmbedder:
    """Unit bag-of-words vectors: each word adds one to a hashed place."""

    def __init__(self, dim: int = 64, max_chars: int = 8191 * 4):
        self.dim, self.max_chars = dim, max_chars

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"\w+", (t or "")[: self.max_chars].lower()):
                v[int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") % self.dim] += 1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class CachedEmbedder:
    """V-07: vectors of the last texts asked for, at most so many; only unseen texts reach the embedder."""

    def __init__(self, inner: Embedder, size: int = 1000):
        self.inner, self.size, self.rows, self.hits, self.misses = inner, size, OrderedDict(), 0, 0

    @property
    def dim(self) -> int:
        return self.inner.dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        new = [t for t in dict.fromkeys(texts) if t not in self.rows]
        made = dict(zip(new, self.inner.embed(new))) if new else {}
        self.hits, self.misses = self.hits + len(texts) - len(new), self.misses + len(new)
        out = [made[t] if t in made else self.rows[t] for t in texts]
        for t, v in zip(texts, out):
            self.rows[t] = v
            self.rows.move_to_end(t)
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)
        return out


class OverlapReranker:
    """Share of the query's words that a text has; 0.5 for a query without words."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(re.findall(r"\w+", query.lower()))
        return [len(q & set(re.findall(r"\w+", t.lower()))) / len(q) if q else 0.5 for t in texts]


class EchoGenerator:
    """Gives the prompt back: expansion, rewriting and decomposition then fall back to the query itself."""

    def generate(self, prompt: str) -> str:
        return prompt


class PatternExtractor:
    """Entities and relations of a text by fixed patterns, with confidences."""

    PATTERNS = (
        ("Jurisdiction", r"laws of (?:the )?(?:State of )?([A-Z][a-z]+(?: [A-Z][a-z]+)?)"),
        ("Party", r"([A-Z][A-Za-z&]+(?: [A-Z][A-Za-z&]+)* (?:Inc|LLC|Corp|Ltd|Company)\.?)"),
        ("TerminationClause", r"((?:may|shall) terminate[^.]{0,120})"),
        ("PaymentTerm", r"(pay(?:ment|s)?[^.]{0,20}\d+ days)"),
        ("ConfidentialityClause", r"(confidential information[^.]{0,80})"),
    )

    def extract(self, text: str) -> dict:
        ents = [{"label": label, "name": m.strip(), "confidence": 0.9} for label, p in self.PATTERNS for m in dict.fromkeys(re.findall(p, text or ""))]
        parties = [e["name"] for e in ents if e["label"] == "Party"]
        rels = [{"source": p, "target": e["name"], "rel_type": "GOVERNED_BY", "confidence": 0.8, "evidence": e["name"]} for p in parties for e in ents if e["label"] == "Jurisdiction"]
        return {"entities": ents, "relationships": rels}


#: Registered implementations by kind and name.
REGISTRY = {"embedder": {"hash": HashEmbedder}, "reranker": {"overlap": OverlapReranker}, "generator": {"echo": EchoGenerator}, "extractor": {"pattern": PatternExtractor}}


def create(kind: str, name: str, **options):
    """A provider by kind and name; unknown names are errors that list the known ones."""
    if name not in REGISTRY.get(kind, {}):
        raise ValueError(f"unknown {kind} {name!r}; known: {sorted(REGISTRY.get(kind, {}))}")
    return REGISTRY[kind][name](**options)
