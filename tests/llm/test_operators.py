"""The pipeline operators against brute force, library results, and on odd rows: nulls, empty and very long texts,
ties, repeated rows, empty tables, extra columns with clashing names."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import bagminhash, common, decontaminate, hnsw, html_text, langid, mixing, quality, queries, records, substrings, token_count

LONG = " ".join(f"long{k % 977}" for k in range(30_000))
ODD = [(None, "a null id with several words in it", "en", "s0"), (1, None, None, None), (2, "", "en", "s1"), (3, " \n\t ", "de", "s1"), (4, LONG, "en", "s0"), (5, "one two", "en", "s0"), (5, "one two", "en", "s0"), (6, "Ünïcode — 漢字 🎉 <s> <|endoftext|>  x", "fr", "s2"), (7, LONG + " tail", "en", None)]
SCHEMA = "doc_id long, text string, lang string, source string"


def extra():
    return {c: F.lit(1) for c in ("n_words", "score", "size", "taken", "row", "id", "start", "spans", "kept", "x", "item", "_text", "n_bytes")}



@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra())


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1 -----------------------------------------------------------------------------------------------------------------


def brute_links(v, threshold):
    ok = {k: np.asarray(e, float) for k, (_, e) in enumerate(v) if v[k][0] is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    parent = {k: k for k in range(len(v))}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    n = Counter()
    for i in ok:
        for j in ok:
            if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= threshold:
                n[i] += 1
                n[j] += 1
                parent[find(j)] = find(i)
    least = {}
    for k in range(len(v)):
        if v[k][0] is not None:
            least[find(k)] = min(least.get(find(k), v[k][0]), v[k][0])
    return sorted(((v[k][0], n[k], least.get(find(k)) if v[k][0] is not None else None) for k in range(len(v))), key=str)


def test_near_vectors(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(12, 16))
    v = [(k, [float(x) for x in base[k % 12] + r.normal(size=16) * 0.12]) for k in range(300)]
    v += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] + [1.0] * 15), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (None, v[0][1]), (407, v[1][1]), (1, v[1][1]), (408, [1e300] * 16), (409, [1e-300] * 16), (410, [float("inf")] * 16)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumns(extra())
    got = hnsw.near_vectors(df, 0.95)["vectors"]
    assert rows(got.select("vec_id", "n_links", "component_id")) == brute_links([(i, e if i not in (408, 409) else [1.0] * 16) for i, e in v], 0.95)
    assert rows(hnsw.near_vectors(df.limit(0))["vectors"]) == []


def test_graph_recall():
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = hnsw.Graph(x)
    assert len(g.layers) > 1
    ids, sims = g.search(x[::50], 96)
    true = np.argsort(-(x[::50] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, true)]) >= 0.9
    assert (np.diff(sims, axis=1) <= 1e-6).all()


class Lossy(hnsw.Graph):
    """A graph whose first beam loses links of the places it is told (-1: of vectors that are not its own)."""

    lost = ()

    def _walk(self, q, ids, found, low, most=1 << 17):
        sims = q @ self.x.T
        own, to_self = sims.argmax(axis=1), sims > 1 - 1e-5
        if ids.shape[1] == 16:
            hide = np.where(to_self.any(axis=1), np.isin(own, self.lost), -1 in self.lost)
            sims[hide[:, None] & ~to_self] = -1
        return np.nonzero(sims >= low)


def test_audit_of_links(monkeypatch):
    monkeypatch.setattr(hnsw, "NEAREST", 0)
    r = np.random.default_rng(2)

    def unit(v):
        return (v / np.linalg.norm(v, axis=-1, keepdims=True)).astype(np.float32)

    x = unit(r.normal(size=(2000, 64)))
    pick = np.random.default_rng(7).choice(2000, 256, replace=False)
    free = np.setdiff1d(np.arange(2000), pick)
    x[free[:2]] = unit(x[pick[:2]] + unit(r.normal(size=(2, 64))) * 0.1)  # two links among 256 sampled vectors
    x[free[10:30]] = unit(x[pick[9]] + unit(r.normal(size=(20, 64))) * 0.1)  # 20 links, more than the first beam
    g = Lossy(x)
    assert g.audit(0.95, 0.99) == 16
    for lost in ([pick[0], pick[1]], [pick[9]]):
        g.lost = lost
        assert g.audit(0.95, 0.99) == 32
    g.lost = [-1]  # of other shards' vectors
    assert g.audit(0.95, 0.99, unit(x[free[100:110]] + unit(r.normal(size=(10, 64))) * 0.1)) == 32
    g._walk = lambda q, ids, sims, low: (np.zeros(0, int), np.zeros(0, int))
    with pytest.raises(RuntimeError):
        g.audit(0.95, 0.99)


def test_audit_sees_small_groups(monkeypatch):
    """The one link of a query does not vanish among the 200 of another."""
    monkeypatch.setattr(hnsw, "NEAREST", 0)
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 64))
    pick = np.random.default_rng(7).choice(2000, 256, replace=False)
    free = np.setdiff1d(np.arange(2000), pick)
    x[free[0]] = x[pick[0]] + r.normal(size=64) * 0.1
    x[free[10:210]] = x[pick[9]] + r.normal(size=(200, 64)) * 0.1
    g = Lossy((x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32))
    assert g.audit(0.95, 0.99) == 16
    g.lost = [pick[0]]
    assert g.audit(0.95, 0.99) == 32


def test_walk_in_both_directions():
    """A part of a group that has links to the rest and none back is found from the rest."""
    r = np.random.default_rng(4)
    x = r.normal(size=16) + r.normal(size=(60, 16)) * 0.05
    g = hnsw.Graph(x / np.linalg.norm(x, axis=1)[:, None])
    nodes, place, links = g.layers[-1]
    g.layers[-1] = nodes, place, np.where((nodes[:, None] >= 10) & (links < 10), -1, links)
    _, found = g._walk(g.x[30:31], np.array([[30]]), np.ones((1, 1), np.float32), 0.93)
    assert sorted(found) == np.flatnonzero(g.x @ g.x[30] >= 0.93).tolist() and min(found) < 10


def test_large_group_needs_no_wide_beam():
    r = np.random.default_rng(2)
    x = r.normal(size=(2500, 64))
    at = r.permutation(2500)[:100]
    x[at] = x[at[0]].copy() + r.normal(size=(100, 64)) * 0.16
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    g, q = hnsw.Graph(x[:2000]), x[2000:]
    links = q @ x[:2000].T >= 0.95
    a, b = g.within(q, 16, 0.93)
    assert links.sum() > 1000 and links[a, b].sum() == links.sum()
    assert g.audit(0.95, 0.99, q) == 16


def test_links_of_large_groups(spark):
    """0.99 of the links of brute force and no other, on 20,000 vectors with groups of 2 to 1,500."""
    r = np.random.default_rng(5)
    x = r.normal(size=(20_000, 32))
    at = 0
    for size in (1500, 600, *[40] * 20, *[3] * 300, *[2] * 300):
        x[at : at + size] = x[at] + r.normal(size=(size, 32)) * r.uniform(0.1, 0.2)
        at += size
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = {row["vec_id"]: row for row in hnsw.near_vectors(v.repartition(4), 0.95)["vectors"].collect()}
    links = np.concatenate([(x[k : k + 1000] @ x.T >= 0.95).sum(axis=1) - 1 for k in range(0, len(x), 1000)])
    own = np.array([got[k]["n_links"] for k in range(len(x))])
    assert (own <= links).all() and own.sum() >= 0.99 * links.sum() and (own[links == 0] == 0).all()
    assert all(got[k]["component_id"] == k for k in np.flatnonzero(links == 0))
    assert np.mean([got[k]["component_id"] == 0 for k in range(1500) if links[k] > 3]) > 0.99


# 2 -----------------------------------------------------------------------------------------------------------------


def bag(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def brute_components(rs, threshold=0.8):
    ids = sorted({i for i, _ in rs if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(i, bag(t)) for i, t in rs if i is not None and bag(t)]
    for k, (i, a) in enumerate(own):
        for j, b in own[k + 1 :]:
            if sum((a & b).values()) >= threshold * sum((a | b).values()):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def near_texts():
    r = random.Random(2)
    vocab = [f"w{k}" for k in range(400)]
    out = []
    for g in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([3, 8, 60, 200]))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, 2 + len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append((len(out), " ".join(w) + r.choice(["", "!", " ."])))
    return out


def test_near_duplicates(spark, odd, none):
    rs = near_texts()
    got = bagminhash.near_duplicates(spark.createDataFrame(rs, "doc_id long, text string"))["documents"]
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute_components(rs)
    o = bagminhash.near_duplicates(odd)["documents"].collect()
    assert len(o) == len(ODD)
    assert {r["doc_id"]: r["component_id"] for r in o if r["doc_id"] is not None} == brute_components([x[:2] for x in ODD])
    kept = bagminhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6]
    assert kept.where("doc_id is null").count() == 1
    assert bagminhash.near_duplicates(none)["documents"].count() == 0
    clash = spark.createDataFrame([(1, "a b c d e f", 7), (1, "u v w x y z", 8), (1, "U V W X Y Z", 9), (2, "u v w x y z.", 10), (3, "u v w x y z.", 11)], "doc_id long, text string, _keep int").withColumns({c: F.lit(5) for c in ("_row", "id", "text_hash", "row", "node", "h", "k1")})
    assert rows(bagminhash.near_duplicates(clash)["documents"].select("doc_id", "component_id")) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]
    kept = bagminhash.keep_one(clash)
    assert kept.columns == clash.columns and len({r["text"].lower() for r in kept.collect()}) == kept.count() == 2 and {r["_row"] for r in kept.collect()} == {5}


def test_weighted_jaccard_unbiased():
    r = random.Random(3)
    off = []
    for _ in range(40):
        a = [r.choice("abcdefgh") for _ in range(r.randint(5, 200))] * r.randint(1, 6)
        b = list(a)
        for _ in range(len(a) // 15):
            b[r.randrange(len(b))] = r.choice("abcdefgh")
        s, t = " ".join(a), " ".join(b)
        sig = bagminhash.signatures(*bagminhash.shingles([s.encode(), t.encode()]), 2, 1024)
        x, y = bag(s), bag(t)
        true = sum((x & y).values()) / sum((x | y).values())
        assert bagminhash.similarity(s, t) == pytest.approx(true)
        off.append((sig[0] == sig[1]).mean() - true)
        f = bagminhash.sketches(*bagminhash.shingles([s.encode(), t.encode()]), 2).view(np.uint64)
        assert sum(int(v).bit_count() for v in f[0, bagminhash.LONGS :] ^ f[1, bagminhash.LONGS :]) <= sum((x | y).values()) - sum((x & y).values())
        f = f[:, : bagminhash.LONGS].reshape(2, -1, 4)
        some, differ = ((x[:, 0] | x[:, 1] | x[:, 2] | x[:, 3]) for x in (f[0] | f[1], f[0] ^ f[1]))
        n, d = (sum(int(v).bit_count() for v in x) for x in (some, differ))
        union = sum((x | y).values())
        assert d <= n * (1 - true) + 6 * (true * (1 - true) * n * max(union - n, 0) / max(union - 1, 1)) ** 0.5 + 1
    assert abs(np.mean(off)) < 0.01 and np.max(np.abs(off)) < 0.08


# 3 -----------------------------------------------------------------------------------------------------------------


def leaks(rs, items, n=10):
    W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    win = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            win.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in rs:
        w, hit, ids = words(t), set(), set()
        for p, own in win.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    ids |= own
        out.append((i, len(w), len(hit), ",".join(sorted(str(x) for x in ids if x is not None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_leaks(spark, odd, none, block):
    items = [(1, "Short one"), (2, " ".join(f"b{k}" for k in range(14))), (2, "another text of item two"), (3, None), (4, ""), (None, "null item here now"), (5, "Ünïcode 漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"runs": F.lit(1)})
    rs = [x[:2] for x in ODD] + [(8, "a SHORT, one! " + " ".join(f"b{k}" for k in range(3, 14)) + " b0"), (9, "x null item here now y"), (9, "x null item here now y"), (10, " ".join(f"b{k}" for k in range(9)))]
    df = spark.createDataFrame(rs, "doc_id long, text string").withColumns(extra())
    got = decontaminate.find_leaks(df, bench, 10, block)
    n = F.aggregate("runs", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    assert rows(got.select("doc_id", "n_words", n, F.array_join("items", ","))) == leaks(rs, items)
    spans = got.where("doc_id = 8").first()["spans"]
    assert rs[len(ODD)][1][spans[0]["start"] : spans[0]["end"]].startswith("SHORT, one! b3")
    clean = decontaminate.drop_leaks(df, bench, 10, block)
    assert clean.columns == df.columns and sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(x[0]) for x in leaks(rs, items) if x[2] == 0)
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(df, bench.limit(0)).where(F.size("runs") > 0).count() == 0


# 4 -----------------------------------------------------------------------------------------------------------------

PAGES = {
    "": "",
    "plain  text": "plain text",
    "<p>One<p>Two <b>bold<br>line": "One\n\nTwo bold\nline",
    "<style>.ad, #x{display:none}</style><div class='ad'>no</div><p id=x>no</p><p hidden>no</p>yes<script>no</script>": "yes",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e": "- a\n- b\n  3. c\n  4. d\n\ne",
    "<table><tr><th>Name<th>n<tr><td>apple pie<td>3<tr><td rowspan=2>r<td>1<tr><td>2</table>": "Name       n\napple pie  3\nr          1\n           2",
    "<pre>\n a\n   b\n</pre>": " a\n   b",
    "a<!-- x -->b &amp; &lt;c&gt; 1 < 2": "ab & <c> 1 < 2",
    "<p style='visibility:hidden'>no<i style='visibility:visible'>yes</i></p>": "yes",
    "<details><summary>s</summary>no</details><dl><dt>t<dd>d</dl>": "s\n\nt\n  d",
    "</p></div><td>x": "x",
    "<style>@media print{.a{display:none}} @media screen{.b{display:none}}</style><p class=a>a<p class=b>b": "a",
    "<style>p{display:none} p.show{display:block}</style><p class=show>yes<p>no": "yes",
    "<style>div.ad, .x b{display:none}</style><div class=ad>no</div><i class=ad>i</i><p class=x>x<b>no</b>": "i\n\nx",
    "<div><style>.a{display:none!important} /* .c{display:none} */</style></div><p class=a style='display:block'>no<p class=c>c": "c",
    "<style>.a{display:none}</style><p class=a style='display:block'>yes<p class=a>no": "yes",
    "<style>p:hover{display:none} p{visibility:hidden} .v{visibility:visible}</style><p>no<b class=v>yes</b>": "yes",
    "<table><tr><td><pre>a\n  b</pre><td>x<tr><td><ul><li>c<li>d</ul><td>y</table>": "a    x\n  b\n- c  y\n- d",
    "<table><tr><td colspan=99999999>a<td>b</table>": "a  b",
    "<a title='x > y'>z</a> <a \"b>c": "z c",
    "<title>no</title><textarea>a <b>c</textarea>": "a <b>c",
}


@pytest.mark.parametrize("page", PAGES)
def test_render(page):
    assert html_text.render(page) == PAGES[page]


def test_broken_pages_take_linear_time():
    import time

    for part in ('<a "', "<a '\"", "<!-- ", "<", "<x ", "<style>.a{", "<p class=a "):
        began = time.perf_counter()
        html_text.render(part * (1_000_000 // len(part)))
        assert time.perf_counter() - began < 5, part


def test_list_numbers():
    got = html_text.render("<ol start=1990><li>a<li value=2024>b<li>c</ol><ol start=-1500><li>d</ol>")
    assert got.split() == ["1990.", "a", "2024.", "b", "2025.", "c", "-1500.", "d"]


def test_render_deep_and_table(spark, sf_dir):
    assert html_text.render("<div><ul><li>" * 20_000 + "x").strip().endswith("x")
    got = html_text.extract_text(spark.createDataFrame([(1, None), (None, "<p>a"), (1, "")], "page_id long, html string").withColumn("text", F.lit("clash")))
    assert rows(got) == [(1, ""), (1, None), (None, "a")]
    assert queries.op4_html_text(spark, sf_dir).where("n_chars = 0 or text is null").count() == 0


# 5 -----------------------------------------------------------------------------------------------------------------


def test_records(spark, odd, none, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for df in (odd, docs):
        manifest = records.write_records(df, path)
        got = sorted((tuple(r) for r in records.read_records(spark, manifest).collect()), key=lambda r: r[1])
        want, start = [], 0
        for i, t in sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
            ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
            want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want
    i, ids = records.read_record(manifest[0]["path"], 1)
    assert len(ids) == got[1][2] and i == got[1][0]
    assert records.read_records(spark, records.write_records(none, path)).count() == 0


def test_piece_encoder():
    enc = records.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), cache_entries=50)
    r = random.Random(4)
    parts = ["a", "the", " ", "\n", "\t", " \n", "é", "'s", "12", "<|endoftext|>", " ", " ", "\x85", "\x1c", "　", ".", "漢", "🎉", " x", "Word,", " w?", "'", "'ll", "²", "ɏ", "ɐ", "\xa0", "½x", "_", "...", "\r\n", "ºª", "\x00", "×"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert enc.encode(t) == enc.pack(enc.tok.encode(t, add_special_tokens=False).ids), repr(t)


def test_broken_record(tmp_path):
    p = tmp_path / "x.bin"
    p.write_bytes(records.frame(b"payload")[:-1] + b"\0")
    with open(p, "rb") as f, pytest.raises(ValueError):
        list(records.frames(f))


# 6, 8 --------------------------------------------------------------------------------------------------------------


def test_quality(spark, sf_dir, odd, none):
    got = queries.op6_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, 1), (None, 1), (99, 0), (2, None), (3, 7)], "doc_id long, quality int").withColumn("score", F.lit(1))
    out = quality.score_quality(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert {r["score"] for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.score_quality(odd, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.score_quality(none, labels).count() == 0
    assert quality.keep_good(odd, labels.limit(0)).count() == len(ODD)


def test_language(spark, odd, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    out = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in langid.predict_languages(odd).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] in ("en", "de", "fr")
    assert langid.predict_languages(none).count() == 0
    assert {r["lang_pred"] for r in langid.predict_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 7 -----------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, odd, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_count.count_tokens(odd, path)
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, *_ in ODD]
    assert rows(got) == sorted(want, key=str)
    assert token_count.count_tokens(none, path).count() == 0
    m, r = token_count.PairMerger(path, cache_entries=50), random.Random(5)
    for _ in range(4000):
        t = "".join(r.choice(" \t\n  ▁aeéñst<s>🎉漢字\x00.,  the") for _ in range(r.randint(0, 30)))
        assert m.count(t) == len(sp.encode(t)), repr(t)


# 9 -----------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, set(sizes)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free -= over
    return out


def brute_slots(spark, mix, block_words, shard_slots, seed):
    """How often slot j of a source is there, its blocks and slots, from the targets alone: the draws, one by one."""
    t = sorted((r for r in mix["targets"].collect() if r["source_size"]), key=lambda r: r["sidx"])
    blocks = {r["sidx"]: -(-r["source_size"] // block_words) for r in t}
    slots = {r["sidx"]: min(int(r["target"] * blocks[r["sidx"]] / r["source_size"] + 0.5), 2 * blocks[r["sidx"]]) for r in t}
    line = [s for s in slots for _ in range(slots[s])]
    draws = [(k // shard_slots, k % shard_slots) for k in range(len(line))]
    rs = spark.createDataFrame(draws or [(0, 0)], "shard long, i long").select(F.xxhash64(F.lit(seed), "shard", "i")).collect()
    j, over, took = Counter(), 0, Counter()
    for (r,), _ in zip(rs, draws):
        s = line[r % len(line)]
        over += j[s] >= slots[s]
        j[s] += j[s] < slots[s]
    assert over == sum(slots[s] - j[s] for s in slots)
    for s in slots:
        for k in range(slots[s]):
            took[s, k] += 1
    return took, blocks, slots


def test_mixing(spark, odd, none, docs):
    for df in (odd, docs):
        for options in ({}, {"block_words": 16, "shard_slots": 64}):
            mix = mixing.mix_sources(df, **options)
            got = mix["documents"].collect()
            size = Counter()
            for r in df.collect():
                size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
            want = brute_targets(dict(size))
            assert len(got) == df.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
            for s in size:
                own = [r for r in got if r["source"] == s]
                assert {r["source_size"] for r in own} == {size[s]} and all(r["target"] == pytest.approx(want[s]) for r in own)
                assert abs(sum(r["taken"] for r in own) - want[s]) <= 130 + 0.02 * want[s]
            # taken is the join of slots and blocks
            took, blocks, slots = brute_slots(spark, mix, options.get("block_words", 128), options.get("shard_slots", 8192), 20_011)
            plan = [(r["sidx"], r["j"], r["block"], r["shard"]) for r in mix["slots"].collect()]
            assert Counter(x[:2] for x in plan) == took
            for s in slots:
                for lap in range(-(-slots[s] // blocks[s])):
                    at = [b for i, j, b, _ in plan if i == s and j // blocks[s] == lap]
                    assert len(set(at)) == len(at) and set(at) <= set(range(blocks[s]))
            times = Counter(x[0::2][:2] for x in plan)
            words = Counter()
            for r in mix["pieces"].collect():
                words[r["doc_id"], r["row"]] += r["words"] * times[r["sidx"], r["block"]]
            assert {k: v for k, v in words.items() if v} == {k: v for k, v in (sum((Counter({(r["doc_id"], r["row"]): r["taken"]}) for r in got), Counter())).items() if v}
            assert rows(mixing.mix_sources(df.repartition(3), **options)["documents"]) == rows(mix["documents"])
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns and again.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixing.mix_sources(none)["documents"].count() == 0
    clash = odd.withColumns({c: F.lit(7) for c in ("_row", "_copy", "_at", "_id", "at", "copies", "alike", "times", "whole", "sidx", "block")})
    out = mixing.mixed_documents(clash)
    assert out.columns == clash.columns and {r["_row"] for r in out.collect()} == {7} and out.count() > 0
    assert mixing.mixed_documents(none).count() == 0


def test_draws(spark):
    """Source counts of a shard are multinomial: means and variances over 400 shards; totals are exact."""
    t = spark.createDataFrame([("a", 0, 100_000, 150_000.0), ("b", 1, 50_000, 40_000.0), (None, 2, 10_000, 10_000.0)], "source string, sidx int, source_size long, target double")
    slots = mixing.plan_slots(t, 1, 500, 3).groupBy("shard", "sidx").count().collect()
    n = np.zeros((400, 3))
    for r in slots:
        n[r["shard"], r["sidx"]] = r["count"]
    assert (n.sum(axis=1) == 500).all() and n.sum(axis=0).tolist() == [150_000, 40_000, 10_000]
    p = np.array([0.75, 0.2, 0.05])
    assert np.allclose(n.var(axis=0) / (500 * p * (1 - p)), 1, atol=0.3)


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        p = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(1), 5)).collect()]
        assert sorted(p) == list(range(n))


# 10 ----------------------------------------------------------------------------------------------------------------


def brute_cut(rs, n):
    first = {}
    for i, t in rs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - n + 1) if i is not None else ():
            first[tuple(w[k : k + n])] = min(first.get(tuple(w[k : k + n]), i), i)
    out = []
    for i, t in rs:
        w, gone = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set()
        for k in range(len(w) - n + 1) if i is not None else ():
            if first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"max_bits": 1 << 16}])
def test_substrings(spark, odd, none, docs, options):
    assert rows(substrings.dedup_substrings(odd, 13, **options)) == brute_cut([x[:2] for x in ODD], 13)
    r = random.Random(6)
    rs = [(r.choice([None, *range(9)]), r.choice([None, "", " \n"]) if r.random() < 0.1 else " ".join(r.choice("abc") for _ in range(r.randint(0, 40)))) for _ in range(50)]
    assert rows(substrings.dedup_substrings(spark.createDataFrame(rs, "doc_id long, text string"), 6, **options)) == brute_cut(rs, 6)
    if not options:
        assert rows(substrings.dedup_substrings(docs, 13)) == brute_cut([(x["doc_id"], x["text"]) for x in docs.collect()], 13)
        assert substrings.dedup_substrings(none).count() == 0


def test_suffix_automaton():
    r = random.Random(7)
    for _ in range(100):
        tree, seen = substrings.SuffixAutomaton(), {}
        for d in range(1, 6):
            w = [r.choice("ab") for _ in range(r.randint(0, 14))]
            got, whole = tree.match(w, d, 4)
            assert got == [k for k in range(len(w) - 3) if tuple(w[k : k + 4]) in seen]
            if not whole:
                tree.add(w, d)
            seen |= {tuple(w[k : k + 4]): d for k in range(len(w) - 3)}


# shared ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("each", [1 << 20, 4])
def test_components(spark, monkeypatch, each):
    monkeypatch.setattr(common, "CONTRACT_EDGES", each)
    e = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    d, seen = docs, {}
    for name, f in c.STAGES:
        out = f(spark, d, sf_dir)
        d, _ = common.materialize(out, name)
        seen[name] = d
        if name != "token_records":
            assert d.columns == docs.columns
    model_kept = {r["doc_id"] for r in seen["quality"].collect()}
    scores = {r["doc_id"]: r["predicted"] for r in queries.op6_quality(spark, sf_dir).collect()}
    assert model_kept == {i for i, p in scores.items() if p == 1}
    comp = brute_components([(i, held[i]) for i in sorted(model_kept)])
    assert sorted(r["doc_id"] for r in seen["near_duplicates"].collect()) == sorted({comp[i] for i in model_kept})
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    own = sorted({comp[i] for i in model_kept})
    assert sorted(r["doc_id"] for r in seen["decontaminate"].collect()) == [i for i, _, hit, _ in sorted(leaks([(i, held[i]) for i in own], bench), key=lambda x: x[0]) if not hit]
    mixed = Counter(r["doc_id"] for r in seen["mix"].collect())
    assert max(mixed.values()) <= 2 and Counter(r["doc_id"] for r in seen["token_records"].collect()) == mixed


@pytest.mark.parametrize("name", ["op1_near_vectors", "op2_minhash", "op3_decontaminate", "op10_substrings"])
def test_sql(spark, sf_dir, name):
    import duckdb

    from lodestrata.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    cols = [x[0] for x in got.description]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == sorted(got.fetchall())
