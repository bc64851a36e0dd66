"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class. Classes are dealt to shards by hash; each shard builds a graph: levels by a hash, each
level a graph of at most M links per node chosen by the usual diversity rule, filled by inserting batches that search
the graph so far; nodes of the base level that its first node does not reach get a bridge to their nearest reached one.
A query is a beam search; from every found vector within a margin of the threshold the graph is then walked on, along
links in both directions, as long as more such vectors are found, so a large group needs no wide beam. Each shard audits
itself: for samples of its own vectors and of other shards' it compares what queries find with brute force over the
shard, and widens the beam until 0.99 of the links are found, as much of each query's links on average, and the nearest
vector of 0.75 of the queries, most of which have no link (a vector itself counts as neither); a beam as wide as the
shard reaches all of it, and if even that fails the audit the run fails.

Graphs are written to the shared folder once. Every class queries every shard: a task holds a block of classes and reads
one graph after the other. Found pairs are verified by cosine in double precision. A task gives a count of links for
each class and, for the components, a spanning forest of the links it found, so what it gives does not grow with the
square of a group.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors of another
length, link with nothing; repeated rows are vectors of their own and link with each other; a null id links with
nothing; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_uri, connected_components, forest, materialize, new_path, tidy, tune

M, BASE_M, EF_BUILD = 12, 24, 64
#: Shards below the size at which more are made; vectors and bytes of a shard at most; queries and bytes of a block.
SHARDS, SHARD_ROWS, SHARD_BYTES, BLOCK_ROWS, BLOCK_BYTES = 8, 50_000, 64 << 20, 16_384, 16 << 20
BATCH = 256
#: About so many vectors of all shards audit each shard, besides its own sample.
AUDIT_ROWS = 512
#: How far below the threshold the walk goes on; of how many audited queries the beam must find the nearest vector.
MARGIN, NEAREST = 0.02, 0.75


def _distinct(a):
    """The values of an array in order; numpy's own function hashes them, which takes longer."""
    import numpy as np

    a = np.sort(a)
    return a[np.diff(a, prepend=a[:1] - 1) != 0]


def _dots(x, i, y, j):
    """Inner products of rows i of x and j of y, a thousand at a time, which stay in the processor's cache."""
    import numpy as np

    out = np.empty(len(i), np.float32)
    for k in range(0, len(i), 1024):
        a, b = (v.take(at[k : k + 1024], axis=0, mode="clip") for v, at in ((x, i), (y, j)))
        np.einsum("nd,nd->n", a, b, out=out[k : k + 1024])
    return out


class Graph:
    """Layered proximity graph over unit vectors (float32)."""

    def __init__(self, x, seed: int = 1):
        import numpy as np

        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(M)).astype(int), 6)
        self.close = None
        self.layers = []  # from the top: (nodes, place of a node among them, links)
        upper = None
        for l in range(level.max(initial=0), -1, -1):
            nodes = np.flatnonzero(level >= l)
            if l and len(nodes) < 2 * M:
                continue
            self._grow(nodes, BASE_M if l == 0 else M, upper)
            upper = len(self.layers)
        if n:
            self._bridge()

    def __getstate__(self):
        return [(nodes.astype("int32"), links.astype("int32")) for nodes, _, links in self.layers]

    def __setstate__(self, layers):
        import numpy as np

        self.x, self.close, self.layers = None, None, []
        for nodes, links in layers:
            place = np.full(len(layers[-1][0]), -1, np.int64)
            place[nodes] = np.arange(len(nodes))
            self.layers.append((nodes.astype(np.int64), place, links))

    def _bridge(self) -> None:
        """Two more links a node in the base level, for what its first node does not reach: from the nearest reached node
        that has room, and back."""
        import numpy as np

        nodes, place, links = self.layers[-1]
        n = len(nodes)
        links = np.concatenate([links, np.full((n, 2), -1, np.int64)], axis=1)
        reached, front = np.zeros(n, bool), np.zeros(1, np.int64)
        while True:
            reached[front] = True
            while len(front):
                near = np.unique(links[front])
                front = near[(near >= 0) & ~reached[np.maximum(near, 0)]]
                reached[front] = True
            if reached.all():
                break
            new = int(np.argmin(reached))
            sims = np.where(reached & (links < 0).any(axis=1), self.x @ self.x[new], -3)
            old = int(np.argmax(sims))
            for a, b in ((old, new), (new, old)):
                room = np.flatnonzero(links[a] < 0)
                links[a, room[0] if len(room) else -1] = b
            front = np.array([new])
        self.layers[-1] = (nodes, place, links)

    def _grow(self, nodes, most: int, upper) -> None:
        """Insert the nodes of one layer in batches."""
        import numpy as np

        place = np.full(len(self.x), -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        links = np.full((len(nodes), most), -1, np.int64)
        layer = (nodes, place, links)
        x = self.x[nodes]
        done = min(len(nodes), 2 * most)
        sims = x[:done] @ x[:done].T
        np.fill_diagonal(sims, -2)
        order = np.argsort(-sims, axis=1)[:, : done - 1]
        links[:done] = self._choose(x, x[:done], order, np.take_along_axis(sims, order, 1), most)
        while done < len(nodes):
            size = min(BATCH, done, len(nodes) - done)
            q = x[done : done + size]
            ids, sims = self._beam(layer, q, self._seeds(layer, q, upper, done), EF_BUILD)
            own = q @ q.T
            np.fill_diagonal(own, -2)
            near = np.argsort(-own, axis=1)[:, :8]
            ids = np.concatenate([ids, near + done], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], axis=1)
            order = np.argsort(-sims, axis=1)
            chosen = self._choose(x, q, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), most)
            links[done : done + size] = chosen
            new, at = np.nonzero(chosen >= 0)
            self._back(x, links, chosen[new, at], new + done, most)
            done += size
        self.layers.append(layer)

    def _choose(self, x, q, ids, sims, most: int):
        """Of candidates in falling order of similarity, those nearer to q than to any taken one; then the nearest."""
        import numpy as np

        b, c = ids.shape
        out = np.full((b, most), -1, np.int64)
        if not c:
            return out
        v = x[np.maximum(ids, 0)]
        among = v @ v.transpose(0, 2, 1)
        taken = np.zeros((b, c), bool)
        count = np.zeros(b, np.int64)
        valid = (ids >= 0) & (sims > -1.5)
        for k in range(c):
            ok = valid[:, k] & (count < most) & ~((among[:, k, :k] > sims[:, k, None]) & taken[:, :k]).any(axis=1)
            taken[:, k] = ok
            count += ok
        rest = valid & ~taken
        room = np.maximum(most * 3 // 4 - count, 0)
        taken |= rest & (np.cumsum(rest, axis=1) <= room[:, None])
        rows, cols = np.nonzero(taken)
        nth = np.cumsum(taken, axis=1)[rows, cols] - 1
        fits = nth < most
        out[rows[fits], nth[fits]] = ids[rows[fits], cols[fits]]
        return out

    def _back(self, x, links, to, new, most: int) -> None:
        """Links from old nodes to new ones, 16 at a time; a full node chooses again."""
        import numpy as np

        order = np.lexsort((new, to))
        to, new = to[order], new[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for done in range(0, count.max(initial=0), 16):
            on = count > done
            own, extra = nodes[on], np.full((on.sum(), min(count.max() - done, 16)), -1, np.int64)
            for k in range(extra.shape[1]):
                has = count[on] > done + k
                extra[has, k] = new[first[on][has] + done + k]
            ids = np.concatenate([links[own], extra], axis=1)
            sims = np.where(ids >= 0, np.einsum("bcd,bd->bc", x[np.maximum(ids, 0)], x[own]), -2)
            order = np.argsort(-sims, axis=1)
            links[own] = self._choose(x, x[own], np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), most)

    def _seeds(self, layer, q, upper, inserted: int):
        """Where to enter a layer: what the layers above find, or its first nodes."""
        import numpy as np

        if not upper:
            return np.tile(np.arange(min(inserted, 4)), (len(q), 1))
        at = layer[1][self._descend(q, upper)]
        return np.where(at < inserted, at, 0)

    def _descend(self, q, layers: int):
        """Nodes near q in the last of the first so many layers."""
        import numpy as np

        found = None
        for layer in self.layers[:layers]:
            if found is None:
                seeds = np.tile(np.arange(min(len(layer[0]), 8)), (len(q), 1))
            else:
                seeds = layer[1][found]
            ids, _ = self._beam(layer, q, seeds, 12)
            found = layer[0][np.where(ids[:, :4] >= 0, ids[:, :4], ids[:, :1])]
        return found

    def _beam(self, layer, q, seeds, ef: int, step: int = 4):
        """The ef most similar nodes found for each query, in falling order: (places or -1, similarities). A found node is a
        key of 64 bits, in order of similarity: that, the place, and whether the node is still to be opened."""
        import numpy as np

        nodes, _, links = layer
        b, n = len(q), len(nodes)
        x = self.x if n == len(self.x) else self.x[nodes]
        none = np.iinfo(np.int64).min
        keys, seen = np.full((b, ef), none), np.zeros(b * n, bool)
        at = _distinct(((np.arange(b) * n)[:, None] + seeds[:, :ef]).ravel())
        while True:
            seen[at] = True
            r, c = at // n, at % n
            bits = _dots(x, c, q, r).view(np.int32)
            new = ((bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32) | (c << 1) | 1
            on = new > keys[r, 0]
            r, new = r[on], new[on]
            if len(r):
                count = np.bincount(r, minlength=b)
                own = np.flatnonzero(count)
                wide = np.full((len(own), count.max()), none)
                wide[np.arange(count.max()) < count[own, None]] = new
                wide = np.concatenate([keys[own], wide], axis=1)
                wide.sort(axis=1)
                keys[own] = wide[:, -ef:]
            todo = (keys & 1).astype(bool)
            live = np.flatnonzero(todo.any(axis=1))
            if not len(live):
                break
            todo = todo[live, ::-1]
            r, c = np.nonzero(todo & (np.cumsum(todo, axis=1, dtype=np.int32) <= step))
            r, c = live[r], ef - 1 - c
            best = keys[r, c]
            keys[r, c] = best ^ 1
            near = links[(best & 0xFFFFFFFF) >> 1]
            at = ((r * n)[:, None] + near)[near >= 0]
            at = _distinct(at[~seen[at]])
        keys = keys[:, ::-1]
        bits = (keys >> 32).astype(np.int32)
        sims = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).view(np.float32)
        return np.where(keys > none, (keys & 0xFFFFFFFF) >> 1, -1), np.where(keys > none, sims, np.float32(-2))

    def search(self, q, ef: int):
        """(nodes or -1, similarities) of the ef nearest found."""
        import numpy as np

        q = np.ascontiguousarray(q, dtype=np.float32)
        last = self.layers[-1]
        seeds = np.zeros((len(q), 1), np.int64)  # the first node reaches all others
        if len(self.layers) > 1:
            seeds = np.concatenate([last[1][self._descend(q, len(self.layers) - 1)], seeds], axis=1)
        return self._beam(last, q, seeds, max(min(ef, len(last[0])), 1))

    def within(self, q, ef: int, low: float, most: int = 1 << 17):
        """(query, node) of all found at similarity low or more: by a beam, and by walking on from what is found. About
        32 * `most` links are followed at a time."""
        return self._walk(q, *self.search(q, ef), low, most)

    def _close(self, low: float):
        """Links of the base level in either direction, as (starts, ends): those that two vectors may have that a query has
        both at similarity low or more."""
        import numpy as np

        if self.close is None or self.close[0] != low:
            n, links = len(self.x), self.layers[-1][2]
            bound = np.cos(min(2 * np.arccos(min(max(low, -1), 1)), np.pi)) - 1e-4
            u, k = np.nonzero(links >= 0)
            v = links[u, k]
            on = _dots(self.x, u, self.x, v) >= bound
            both = _distinct(np.concatenate([u[on] * n + v[on], v[on] * n + u[on]]))
            self.close = low, np.searchsorted(both, np.arange(n + 1) * n), both % n
        return self.close[1:]

    def _walk(self, q, ids, sims, low: float, most: int = 1 << 17):
        """A full node drops links to it from its list, so a part of a large group may have links to the rest and none
        back: the walk follows them in both directions."""
        import numpy as np

        q = np.ascontiguousarray(q, dtype=np.float32)
        n, (starts, ends) = len(self.x), self._close(low)
        r, c = np.nonzero((ids >= 0) & (sims >= low))
        c = ids[r, c].astype(np.int64)
        seen, stamp = np.zeros(len(q) * n, bool), np.zeros(len(q) * n, np.int32)
        seen[r * n + c] = True
        found, todo = [(r, c)], [(r, c)]
        while todo:
            r, c = todo.pop()
            count = starts[c + 1] - starts[c]
            upto = np.cumsum(count)
            fits = max(1, np.searchsorted(upto, 32 * most, "right"))
            if len(r) > fits:
                todo.append((r[fits:], c[fits:]))
                r, c, count, upto = r[:fits], c[:fits], count[:fits], upto[:fits]
            near = ends[np.repeat(starts[c] - upto + count, count) + np.arange(count.sum())]
            at = np.repeat(r, count) * n + near
            at = at[~seen[at]]
            stamp[at] = np.arange(len(at), dtype=np.int32)
            at = at[stamp[at] == np.arange(len(at))]
            seen[at] = True
            r, c = at // n, at % n
            on = _dots(self.x, c, q, r) >= low
            if on.any():
                found.append((r[on], c[on]))
                todo.append((r[on], c[on]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def audit(self, threshold: float, recall: float, others=None, sample: int = 256, ef: int = 16) -> int:
        """The beam at which samples of own vectors and others find that share of their links, of all and on average of a
        query's, and NEAREST of the nearest vectors. A vector is not its own neighbour."""
        import numpy as np

        n = len(self.x)
        pick = np.random.default_rng(7).choice(n, min(sample, n), replace=False)
        q = self.x[pick] if others is None else np.concatenate([self.x[pick], np.asarray(others, np.float32)])
        nearest, links = np.zeros(len(q), np.int64), np.zeros((len(q), n), bool)
        for k in range(0, len(q), 64):
            true = q[k : k + 64] @ self.x.T
            own = pick[k : k + 64]
            true[np.arange(len(own)), own] = -2
            nearest[k : k + 64] = true.argmax(axis=1)
            links[k : k + 64] = true >= threshold
        best = np.einsum("nd,nd->n", q, self.x[nearest])
        each = links.sum(axis=1)
        some = each > 0
        while True:
            hit, linked = 0, np.zeros(len(q), np.int64)
            for k in range(0, len(q), 64):
                ids, sims = self.search(q[k : k + 64], ef)
                r, c = self._walk(q[k : k + 64], ids, sims, threshold - MARGIN)
                linked[k : k + 64] = np.bincount(r[links[k : k + 64][r, c]], minlength=len(sims))
                sims = np.where(ids == np.concatenate([pick, np.full(len(q) - len(pick), -9)])[k : k + 64, None], -2, sims)
                hit += (sims.max(axis=1) >= best[k : k + 64] - 1e-6).sum()
            enough = linked.sum() >= recall * each.sum() and (linked[some] / each[some]).sum() >= recall * some.sum()
            if enough and (n < 2 or hit >= NEAREST * len(q)):
                return ef
            if ef >= n:
                raise RuntimeError(f"a shard's graph finds {linked.sum()} of {each.sum()} links and {hit} of {len(q)} nearest vectors")
            ef = min(ef * 2, n)


def _build(table: pa.Table, threshold: float, recall: float, base: str) -> pa.Table:
    """One shard's graph, written to the shared folder under a name of its own; gives the manifest's row."""
    import numpy as np
    import pyarrow.fs as fs

    own = table["own"].to_numpy()
    x = np.asarray(table["x"].combine_chunks().flatten()).reshape(len(own), -1)
    others, x, ids, n = x[~own], x[own], table["cid"].to_numpy()[own], table["n"].to_numpy()[own]
    empty = pa.table({"dim": table["dim"][:0], "path": pa.array([], pa.string())})
    if not len(ids):
        return empty
    order = np.argsort(ids)
    g = Graph(x[order])
    ef = g.audit(threshold, recall, others)
    store, root = fs.FileSystem.from_uri(base)
    store.create_dir(root, recursive=True)
    name = f"graph-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(pickle.dumps((ids[order], n[order], x[order], g, ef), protocol=5))
    tidy()
    return pa.table({"dim": table["dim"][:1], "path": pa.array([f"{base}/{name}"])})


def _load(path: str):
    import numpy as np
    import pyarrow.fs as fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        ids, n, x, g, ef = pickle.loads(f.read())
    g.x = np.ascontiguousarray(x, dtype=np.float32)
    return ids, n, x, g, ef


def _ask(batches, manifest: dict[int, list[str]], threshold: float):
    """A block of classes (cid, dim, x) -> (a, b, n): how many vectors of other classes a links with (b is null), and
    links a, b that unite what the block's links unite (n is null)."""
    import numpy as np

    parts: dict[int, list] = {}
    for batch in batches:
        dims = batch.column(1).to_numpy()
        for d in np.unique(dims):
            own = batch.filter(pa.array(dims == d))
            parts.setdefault(int(d), []).append((own.column(0).to_numpy(), np.asarray(own.column(2).flatten()).reshape(-1, d)))
    for d, held in parts.items():
        who, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        count, u, v = np.zeros(len(who), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for path in manifest.get(d, ()):
            ids, n, y, g, ef = _load(path)
            step = max(16, min(BATCH, (1 << 23) // len(ids)))
            for k in range(0, len(who), step):
                r, c = g.within(x[k : k + step], ef, threshold - MARGIN)
                a, b = [], []
                for j in range(0, len(r), 1 << 16):
                    i, o = r[j : j + (1 << 16)] + k, c[j : j + (1 << 16)]
                    ok = (np.einsum("nd,nd->n", x[i], y[o]) >= threshold) & (who[i] != ids[o])
                    i, o = i[ok], o[ok]
                    count += np.bincount(i, weights=n[o], minlength=len(who)).astype(np.int64)
                    a.append(who[i])
                    b.append(ids[o])
                if a and sum(map(len, a)):
                    u, v = forest(np.concatenate([u, *a]), np.concatenate([v, *b]))
        some = np.flatnonzero(count)
        none = lambda m: pa.nulls(m, pa.int64())
        yield pa.record_batch([pa.array(who[some]), none(len(some)), pa.array(count[some])], names=["a", "b", "n"])
        yield pa.record_batch([pa.array(u), pa.array(v), none(len(u))], names=["a", "b", "n"])
    tidy()


def _divided(e: str, by):
    """An array's elements by a value, which is computed once for the array and not for each element."""
    return F.transform(F.array(F.struct(F.col(e).alias("e"), by.alias("by"))), lambda s: F.transform(s["e"], lambda t: t / s["by"]))[0]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[str, DataFrame]:
    """vectors: (id, n_links, component_id, kept), one row per row; links: (a, b) between classes of equal vectors that
    unite all that links unite."""
    spark = vectors.sparkSession
    tune(spark)
    e = F.col(vector_col)
    fine = F.coalesce(F.col(id_col).isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0), F.lit(False))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.transform(e, lambda t: t.cast("double"))).alias("e"))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    v = v.withColumn("e", F.when(F.col("e").isNotNull(), _divided("e", F.array_max(F.transform("e", F.abs)))))
    v = v.withColumn("cid", F.when(F.col("e").isNotNull(), F.xxhash64("e")))
    x = _divided("e", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, t: s + t * t)))
    classes = v.where("cid is not null").groupBy("cid").agg(F.count("*").alias("n"), F.min("id").alias("rep"), F.first("e").alias("e"))
    classes = classes.select("cid", "n", "rep", F.size("e").alias("dim"), x.alias("x"))
    classes, _ = materialize(classes, "classes")
    stats = classes.agg(F.count("*").alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    total, wide = stats["n"], 8 * stats["dim"]
    shards = max(min(SHARDS, -(-total // 512)), -(-total // max(512, min(SHARD_ROWS, SHARD_BYTES // wide))), 1)
    blocks = max(-(-total // max(64, min(BLOCK_ROWS, BLOCK_BYTES // wide))), min(2 * spark.sparkContext.defaultParallelism, -(-total // 1024)), 1)
    base = arrow_uri(new_path(spark, "graphs"))

    def build(t):
        return _build(t, threshold, recall, base)

    cols = ["dim", "shard", "cid", "n", "x"]
    home = F.pmod("cid", F.lit(shards)).cast("int")
    dealt = classes.withColumn("shard", home).select(*cols, F.lit(True).alias("own"))
    audits = classes.where(F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, AUDIT_ROWS / max(1, total)) * (1 << 30)))
    audits = audits.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home).select(*cols, F.lit(False).alias("own"))
    manifest: dict[int, list[str]] = {}
    for r in dealt.unionByName(audits).groupBy("dim", "shard").applyInArrow(build, "dim int, path string").collect():  # a row per shard
        manifest.setdefault(r["dim"], []).append(r["path"])

    def ask(batches):
        yield from _ask(batches, manifest, threshold)

    found, _ = materialize(classes.select("cid", "dim", "x").repartition(blocks, "cid").mapInArrow(ask, "a long, b long, n long"), "links")
    links, more = found.where("b is not null").select("a", "b"), found.where("b is null").select("a", F.col("n").alias("more"))
    comp, _ = materialize(connected_components(links), "components")
    size = classes.select("cid", "n", "rep")
    least = comp.join(size.select(F.col("cid").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    of = size.join(comp.select(F.col("node").alias("cid"), "component"), "cid", "left").join(least, "component", "left").join(more.withColumnRenamed("a", "cid"), "cid", "left")
    of = of.select(F.col("cid").alias("_cid"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    of, _ = materialize(of, "classes")
    out = v.select("id", "cid").join(of, F.col("cid") == F.col("_cid"), "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return {"vectors": out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), "links": links}
