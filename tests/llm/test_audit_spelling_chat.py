"""Operators 11 to 13 against brute force, and on odd rows: nulls, empty and very long texts, ties, repeated rows, empty
tables, extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import chat, divergence, queries, spelling

LONG = " ".join(f"long{'abcdefghij'[k % 10]}x{'klmnop'[k % 6]}" for k in range(20_000))
ODD = [(None, "a null id with several words in it", "en", "s0"), (1, None, None, None), (2, "", "en", "s1"), (3, " \n\t 12 ", "de", "s1"), (4, LONG, "en", "s0"), (5, "one two Two", "en", "s0"), (5, "one two Two", "en", "s0"), (6, "Ünïcode — 漢字 🎉 <s> ÀÉ x\x00y", "fr", "s2"), (7, LONG + " tail one", "en", None), (8, "one one two tail", "en", "s3"), (9, None, "en", "s4")]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("n", "word", "term", "total", "first", "size", "seat", "slice", "rank", "value", "item", "key", "part", "id", "form", "row", "cell", "kind", "before", "tokens")


def extra(df):
    return df.withColumns({c: F.lit(1) for c in CLASH})


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# 11 ----------------------------------------------------------------------------------------------------------------


def brute_divergences(docs, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in docs:
        g = (lang or "", source or "")
        groups.add(g)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[g].update(found)
        seen[g[0]].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in groups if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def p(c):
            return {t: 1 + Fraction(10**9 * (n + 1), sum(c.values()) + len(kept)).__floor__() for t, n in c.items()}

        def f(a, b):
            return (a - b) ** 2 // b

        mine, q = p(own[source]), p(whole)
        pairs = sorted(((-sum(f(mine[t], other[t]) for t in kept), s.encode()) for s, other in ((s, p(c)) for s, c in own.items() if s != source)))
        terms = sorted((-f(mine[t], q[t]), t.encode()) for t in kept if own[source][t] and mine[t] > q[t])[:top]
        out += [(lang, source, part, x.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, x) in enumerate(found, 1)]
    return sorted(out, key=str)


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def test_divergences(spark, docs):
    got = rows(divergence.divergences(docs, 3, 200), *COLUMNS)
    assert got == brute_divergences([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()], 3, 200)


@pytest.mark.parametrize("least,top", [(1, 3), (2, 200)])
def test_divergences_odd_rows(spark, least, top):
    df = extra(spark.createDataFrame(ODD, SCHEMA))
    assert rows(divergence.divergences(df, least, top), *COLUMNS) == brute_divergences(ODD, least, top)
    assert rows(divergence.divergences(df.limit(0), least, top)) == []


def test_divergences_of_many_seats_slices_and_meetings_in_parts(spark, monkeypatch):
    r = random.Random(3)
    many = [(k, " ".join(f"w{'abcdefghijklmnopqrst'[min(19, int(r.expovariate(0.2)))]}{'xyz'[r.randrange(3)]}" for _ in range(r.randrange(30))), "en", f"s{r.randrange(27)}") for k in range(400)]
    for name, value in (("SLICE_ROWS", 60), ("SEAT_SOURCES", 2), ("HELD_CELLS", 25)):
        monkeypatch.setattr(divergence, name, value)
    got = rows(divergence.divergences(spark.createDataFrame(many, SCHEMA), 3, 5), *COLUMNS)
    assert got == brute_divergences(many, 3, 5)


def test_shares_are_exact_beyond_64_bits():
    n = [0, 5, 10**12, 3 * 10**13]
    assert list(divergence.shares(n, 7 * 10**13, 12345)) == [1 + 10**9 * (x + 1) // (7 * 10**13 + 12345) for x in n]


# 12 ----------------------------------------------------------------------------------------------------------------


def near(a, b):
    """At a distance of exactly one, by definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(docs, every, min_length=5, min_count=3, times=2):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for doc_id, text, *_ in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    by_size, form, out = defaultdict(list), {}, []
    for w in n:
        by_size[len(w)].append(w)
    close = {w: [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by_size[size] if near(w, x)] for w in n}
    for w, found in close.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(close[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


WORDS = ("word", "n", "n_near", "form", "form_n", "root")


def test_spelling(spark, sf_dir, docs):
    got = rows(queries.op12_spelling(spark, sf_dir), *WORDS)
    assert got == brute_variants([tuple(r) for r in docs.select("doc_id", "text").collect()], 97)
    assert any(r[3] for r in got)


def test_spelling_odd_rows(spark):
    chain = [(k, " ".join(["abcde"] * 16 + ["abcdf"] * 8 + ["abcgf"] * 4 + ["abhgf"] * 2 + ["aaaab"] * 3 + ["aaab"] * 9 + ["aabbb"] * 3 + ["aabbé"] * 3 + ["Éaabb"] * 3), None, None) for k in range(2)]
    some = ODD + chain + [(20, "A" * 3000 + " " + "a" * 2999 + " " + "a" * 1500 + "b" + "a" * 1499, None, None)] * 3
    df = extra(spark.createDataFrame(some, SCHEMA))
    for every in (None, 3):
        got = rows(spelling.spelling_variants(df, every=every), *WORDS)
        assert got == brute_variants(some, every)
    assert ("abhgf", 4, 1, "abcgf", 8, "abcde") in rows(spelling.spelling_variants(df), *WORDS)
    assert rows(spelling.spelling_variants(df.limit(0))) == []


def test_deletions_are_hashes_of_the_shorter_word():
    import numpy as np

    def letters(*words):
        return np.array([[ord(c) for c in w] for w in words], np.uint32)

    whole, less, begins = spelling.deletions(letters("banana", "aabbcc"))
    for w, row, start in zip(("banana", "aabbcc"), less, begins):
        for k in range(6):
            assert spelling.deletions(letters(w[:k] + w[k + 1 :]))[0][0] == row[k]
            assert start[k] == (k == 0 or w[k] != w[k - 1])
    assert len({*whole, *less.ravel()}) == 2 + 6 + 3


# 13 ----------------------------------------------------------------------------------------------------------------


def tokens_of(role, text):
    return len(role) + len(text)


def brute_windows(turns, budget, history, tokens):
    """Windows of whole conversations, as lists of (role, text), how many of them are repeated."""
    system, out, k = None, [], 0
    while k < len(turns):
        lead = [system] if system else []
        back, j = [], k
        while j > (1 if system else 0) and sum(map(tokens, turns[j - 1 : k])) <= history:
            j -= 1
        back = turns[j:k] if k else []
        used = sum(map(tokens, lead + back))
        if used + tokens(turns[k]) > budget:
            back, used = [], sum(map(tokens, lead))
        new = [turns[k]]
        while k + len(new) < len(turns) and used + sum(map(tokens, new)) + tokens(turns[k + len(new)]) <= budget:
            new.append(turns[k + len(new)])
        out.append((lead + back, new))
        if k == 0 and turns[0][0] == "system":
            system = turns[0]
        k += len(new)
    return out


ODD_TURNS = [
    (1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "a <\\|im_start|> b <| <\\\\| |> <"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 4, "assistant", ""),
    (2, None, "assistant", "first"), (2, 0, None, "no role"), (2, 0, "a\nrole%0A", "odd role"), (3, 5, "assistant", "only 漢字 🎉"), (None, 0, "user", "null"), (None, 1, "assistant", "conversation"),
    (4, 0, "user", "x " * 30_000), (4, 1, "assistant", "y " * 30_000), (4, 2, "assistant", "short"),
]
TURNS = "conv_id long, turn long, role string, text string"


def expected(turns, budget, history, enc):
    width = 2 if enc.code == "H" else 4

    def tokens(t):
        return len(enc.encode(f"{chat.escape_role(t[0])}\n{chat.escape(t[1])}")) // width + chat.MARK_TOKENS

    by = defaultdict(list)
    for conv, turn, role, text in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        by[conv].append((role or "", text or ""))
    out = []
    for conv, own in by.items():
        found = brute_windows(own, budget, history, tokens)
        said = "".join(t for r, t in own if r == "assistant")
        size = sum(len(chat.written(old + new)[0]) for old, new in found)
        out.append((conv, len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def encoder():
    from lodestrata.llm.records import PieceEncoder

    return PieceEncoder(queries.vocabulary("byte_bpe_50k.json"))


def test_chat(spark, sf_dir, encoder):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-1, 0, "user", queries.INJECTION), (-1, 1, "assistant", queries.INJECTION)]
    assert rows(queries.op13_chat(spark, sf_dir)) == expected(turns, 2048, 256, encoder)


@pytest.mark.parametrize("budget,history", [(2048, 256), (30, 12), (16, 0), (1, 5)])
def test_chat_odd_rows(spark, encoder, budget, history):
    df = extra(spark.createDataFrame(ODD_TURNS, TURNS))
    path = queries.vocabulary("byte_bpe_50k.json")
    at = chat.format_conversations(df, path, budget, history)
    assert rows(chat.digests(spark, at)) == expected(ODD_TURNS, budget, history, encoder)
    for w in spark.read.parquet(at).collect():
        turns = chat.read_turns(w["text"])
        assert w["n_tokens"] <= budget or len(turns) - w["repeats"] == 1
        assert w["text"].count(chat.START) == len(turns) == w["text"].count(chat.END)
    assert rows(chat.digests(spark, chat.format_conversations(df.limit(0), path))) == []


def test_one_large_conversation_is_cut_into_cells(spark, encoder):
    r = random.Random(5)
    turns = [(7, k, "system" if k == 0 else ("user", "assistant")[k % 2], "word " * r.randrange(12)) for k in range(700)] + [(8, 0, "user", "hello")]
    path = queries.vocabulary("byte_bpe_50k.json")
    at = chat.format_conversations(spark.createDataFrame(turns, TURNS), path, budget=60, history=20, cell=500)
    found = sorted((r for r in spark.read.parquet(at).collect() if r["conv_id"] == 7), key=lambda w: (w["cell"], w["window"]))
    assert len({w["cell"] for w in found}) > 5 and len({w["cell"] for w in found if w["window"] == 0}) == len({w["cell"] for w in found})
    every, said = [("system", turns[0][3])], ""
    for k, w in enumerate(found):
        got = chat.read_turns(w["text"])
        assert w["n_tokens"] <= 60 and got[0] == ("system", turns[0][3])
        old, new = got[: w["repeats"]], got[w["repeats"] :]
        assert k == 0 or (len(old) > 1 and old[1:] == every[-(len(old) - 1) :]), "history is what stands before the span"
        every += new if k else new[1:]
        said += "".join(chat.unescape(w["text"][s["start"] : s["end"]]) for s in w["spans"])
    assert every == [(role, text) for conv, _, role, text in turns if conv == 7]
    assert said == "".join(text for conv, _, role, text in turns if conv == 7 and role == "assistant")


def test_escapes_are_reversible():
    r = random.Random(1)
    for _ in range(3000):
        s = "".join(r.choice("<|\\>ab%0A\n") for _ in range(r.randrange(14)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)
