"""Windows over the order of a whole table, without a task that sees the whole table.

``GlobalOrder`` range-partitions rows by the order (equal rows are told apart by where they stand, so that no value is
bound to one task), numbers them within their part and writes them once. Of each part it keeps one row: its size, its
first and last key and the sums it holds. What stands before a part follows from prefix sums over those rows, as many as
there are parts, and is sent to all tasks. Peers that cross parts start where the first part that ends with their key
says. Frames of a few rows before and after see copies of the neighbouring parts' rows.

Parts hold about equal numbers of rows, so no window here has a group that grows with a hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import scratch, table
from .rewrites import decimal

R = Registry()


def _dec(sql: str, n: int) -> str:
    return f"CAST(round(CAST({sql} AS DECIMAL(38,12)), {n}) AS DOUBLE)"


#: Bits that number the rows of a part.
_ROW_BITS = 33


class GlobalOrder:
    """The rows of a table in one order: ``by`` names columns, ``-name`` falling; the first ``keys`` of them (default: all) are
    what peers share, the others break ties. Nulls come first in rising order and last in falling order."""

    def __init__(self, df: DataFrame, by: list[str], keys: int | None = None):
        self.columns = df.columns
        order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in by]
        self.keys = [c.lstrip("-") for c in (by if keys is None else by[:keys])]
        spark = df.sparkSession
        # what tells equal rows apart only has to be spread, so a replayed task may give them other places
        dealt = df.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order, F.asc("_at"))
        dealt = dealt.sortWithinPartitions(*order, "_at").withColumn("_at", F.monotonically_increasing_id())
        path = scratch(spark, "ordered")
        dealt.write.parquet(path)
        rows = spark.read.parquet(path)
        self.rows = rows.withColumns({"_part": F.shiftright("_at", _ROW_BITS).cast("int"), "_at": F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1})
        self._parts: DataFrame | None = None

    def _before(self, name: str) -> Column:
        """The sum of a column over the parts before."""
        w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(name).over(w), F.lit(0))

    def parts(self, **sums: Column) -> DataFrame:
        """A row for each part: _part, _n, _ahead (rows before), and of each given sum what stands before as _before_<name>."""
        p = self.rows.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(k) for k, c in sums.items()])
        return p.select("_part", "_n", self._before("_n").alias("_ahead"), *[self._before(k).alias(f"_before_{k}") for k in sums])

    def numbered(self, row: str = "row", rows: str | None = None) -> DataFrame:
        """W-20: row numbers from 1 on, and the number of all rows."""
        p = self.parts().withColumn("_all", F.sum("_n").over(Window.partitionBy()))
        out = self.rows.join(F.broadcast(p), "_part").withColumn(row, F.col("_ahead") + F.col("_at"))
        return out.select(*self.columns, row, *([F.col("_all").alias(rows)] if rows else []))

    def tiles(self, n: int, name: str = "tile") -> DataFrame:
        """W-03: n tiles of rows, the first ones a row larger where they can't be equal."""
        out = self.numbered("_row", "_rows")
        small, large = F.expr(f"_rows div {n}"), F.col("_rows") % n
        k = F.col("_row") - 1
        tile = F.when(k < large * (small + 1), F.expr(f"(_row - 1) div (_rows div {n} + 1)")).otherwise(large + F.try_divide(k - large * (small + 1), F.greatest(small, F.lit(1))))
        return out.select(*self.columns, (F.floor(tile) + 1).cast("long").alias(name))

    def ranked(self, rank: str = "rank", dense: str | None = None, percent: str | None = None, cumulative: str | None = None) -> DataFrame:
        """W-02, W-11: rank, dense rank, percent_rank and cume_dist over peers, wherever their rows are."""
        key = F.struct(*[F.col(k) for k in self.keys])
        own = Window.partitionBy("_part").orderBy("_at")
        rows = self.rows.withColumn("_new", F.coalesce((~key.eqNullSafe(F.lag(key).over(own))).cast("int"), F.lit(1)))
        rows = rows.withColumn("_run", F.sum("_new").over(own))  # the number of the key within the part
        peers = Window.partitionBy("_part", "_run")
        rows = rows.withColumns({"_start": F.min("_at").over(peers), "_end": F.max("_at").over(peers)})
        # one row for each part: its first and last key, and where the last key starts
        p = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.max("_run").alias("_runs"), F.max("_start").alias("_last_start"), F.min_by(key, "_at").alias("_first"), F.max_by(key, "_at").alias("_last"), F.min("_end").alias("_first_end"))
        w = Window.orderBy("_part")
        p = p.withColumns({"_ahead": self._before("_n"), "_all": F.sum("_n").over(Window.partitionBy()), "_goes_on": F.coalesce(F.col("_first").eqNullSafe(F.lag("_last").over(w)) & (F.row_number().over(w) > 1), F.lit(False))})
        p = p.withColumn("_keys", F.coalesce(F.sum("_runs").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum(F.col("_goes_on").cast("int")).over(w))
        # keys are in order, so parts that end (or begin) with one key are neighbours: the first says where it starts, the
        # last where it ends
        p = p.withColumns({"_from": F.col("_ahead") + F.col("_last_start"), "_to": F.col("_ahead") + F.col("_first_end")})
        starts = p.groupBy(F.col("_last").alias("_k")).agg(F.min("_from").alias("_peers_from"))
        ends = p.groupBy(F.col("_first").alias("_k2")).agg(F.max("_to").alias("_peers_to"))
        p = p.join(starts, F.col("_goes_on") & F.col("_first").eqNullSafe(F.col("_k")), "left").join(ends, F.col("_last").eqNullSafe(F.col("_k2")), "left")
        p = p.select("_part", "_ahead", "_all", "_keys", "_runs", "_goes_on", "_peers_from", "_peers_to")
        out = rows.join(F.broadcast(p.withColumnRenamed("_runs", "_of")), "_part")
        first = F.when(F.col("_goes_on") & (F.col("_run") == 1), F.col("_peers_from")).otherwise(F.col("_ahead") + F.col("_start"))
        last = F.when(F.col("_run") == F.col("_of"), F.greatest(F.coalesce("_peers_to", F.lit(0)), F.col("_ahead") + F.col("_end"))).otherwise(F.col("_ahead") + F.col("_end"))
        made = [first.alias(rank)]
        if dense:
            made.append((F.col("_keys") + F.col("_run")).alias(dense))
        if percent:
            made.append(F.when(F.col("_all") > 1, (first - 1).cast("double") / (F.col("_all") - 1)).otherwise(0.0).alias(percent))
        if cumulative:
            made.append((last.cast("double") / F.col("_all")).alias(cumulative))
        return out.select(*self.columns, *made)

    def running(self, **sums: str) -> DataFrame:
        """W-06, W-19: sums from the first row to each row (ROWS UNBOUNDED PRECEDING); null values add nothing."""
        cols = {f"_v{k}": F.col(c) for k, c in enumerate(sums.values())}
        own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        rows = self.rows.withColumns({k: F.sum(c).over(own) for k, c in cols.items()})
        out = rows.join(F.broadcast(self.parts(**{f"s{k}": F.col(c) for k, c in enumerate(sums.values())})), "_part")
        # as long as all values so far are null, so is the sum
        known = self.parts(**{f"c{k}": F.col(c).isNotNull().cast("long") for k, c in enumerate(sums.values())}).drop("_n", "_ahead")
        out = out.join(F.broadcast(known), "_part")
        made = [F.when((F.col(f"_before_c{k}") > 0) | F.col(f"_v{k}").isNotNull(), F.coalesce(f"_v{k}", F.lit(0)) + F.col(f"_before_s{k}")).alias(n) for k, n in enumerate(sums)]
        return out.select(*self.columns, *made)

    def framed(self, before: int, after: int, **aggregates) -> DataFrame:
        """W-07, W-19: aggregates over ROWS BETWEEN before PRECEDING AND after FOLLOWING; each is a function of a window, as
        ``lambda w: F.avg("x").over(w)``. lag and lead fit as well: they take the frame's order, ``lambda w, o: F.lag("x").over(o)``.
        before and after are small: so many rows are copied at each border."""
        p = self.parts().select("_part", "_n", "_ahead")
        near = F.sequence(F.col("_ahead") - (before - 1), F.col("_ahead")) if before else F.array().cast("array<bigint>")
        far = F.sequence(F.col("_ahead") + F.col("_n") + 1, F.col("_ahead") + F.col("_n") + after) if after else F.array().cast("array<bigint>")
        wanted = p.select(F.col("_part").alias("_for"), F.explode(F.concat(near, far)).alias("_row"))  # (before + after) rows a part
        placed = self.rows.join(F.broadcast(p), "_part").withColumn("_row", F.col("_ahead") + F.col("_at")).drop("_n", "_ahead", "_at")
        copies = placed.join(F.broadcast(wanted), "_row").withColumn("_part", F.col("_for")).drop("_for").withColumn("_copy", F.lit(True))
        every = placed.withColumn("_copy", F.lit(False)).unionByName(copies)
        order = Window.partitionBy("_part").orderBy("_row")
        frame = order.rowsBetween(-before, after)
        made = {n: (f(frame, order) if f.__code__.co_argcount == 2 else f(frame)) for n, f in aggregates.items()}
        return every.withColumns(made).where(~F.col("_copy")).select(*self.columns, *aggregates)


# Exact percentiles -----------------------------------------------------------------------------------------------

#: Cells of a histogram; ranks among fewer values than LEAF_ROWS are looked up in the values themselves.
CELLS = 1024
LEAF_ROWS = 4096
#: Ranks (groups times two a percentile) that are sent to all tasks rather than joined.
SENT_RANKS = 50_000


def _cell(v: Column, lo: Column, hi: Column) -> Column:
    """The cell of a value in [lo, hi]: a rising function of it. Even cells where the ends are close, else even in the
    logarithm (log is semi-monotonic), with a half for each sign where signs differ."""

    def log(x: Column) -> Column:
        return F.least(F.greatest(F.coalesce(F.ln(x), F.lit(-746.0)), F.lit(-746.0)), F.lit(710.0))

    def even(x: Column, a: Column, b: Column) -> Column:
        return F.least(F.greatest(F.floor(F.try_divide(x - a, b - a) * CELLS), F.lit(0)), F.lit(CELLS - 1))

    half = (CELLS - 2) // 2
    share = F.floor((log(F.abs(v)) + 746) / 1457 * half)
    mixed = F.when(v < 0, half - 1 - share).when(v == 0, F.lit(half)).otherwise(half + 1 + share)
    wide = F.when(lo > 0, hi / 4 > lo).otherwise(lo / 4 < hi)
    apart = F.when(lo > 0, even(log(v), log(lo), log(hi))).otherwise(CELLS - 1 - even(log(-v), log(-hi), log(-lo)))
    return F.when((lo <= 0) & (hi >= 0), mixed).when(wide, apart).otherwise(even(v, lo, hi)).cast("int")


def select_ranks(df: DataFrame, group: list[str], value: str, ranks, max_passes: int = 40) -> DataFrame:
    """(group.., rank, value) of exact order statistics: ``ranks`` makes, from a column with the number of a group's values, an
    array of ranks from 1 on. Nulls and NaN are left out; groups may be of any size.

    Each pass counts the cells of a histogram between the ends that a rank is known to lie in, with the least and the
    largest value of each cell, and keeps the cell that holds the rank: a thousandth of what was left. Counts are summed
    up before the shuffle, so a pass moves at most CELLS rows a rank and task. Ranks among a few values are looked up."""
    spark = df.sparkSession
    names = [f"_g{k}" for k in range(len(group))]
    v = df.select(*[F.col(g).alias(n) for g, n in zip(group, names)], F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")

    def kept(x: DataFrame) -> DataFrame:
        path = scratch(spark, "ranks")
        x.write.parquet(path)
        return spark.read.schema(x.schema).parquet(path)

    def met(todo: DataFrame) -> DataFrame:
        few = todo.count() <= SENT_RANKS
        t = todo.select(*[F.col(n).alias(f"{n}t") for n in names], "rank", "lo", "hi", "skip")
        on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}t")) for n in names], F.lit(True))
        return v.join(F.broadcast(t) if few else t, on & F.col("_v").between(F.col("lo"), F.col("hi")))

    first = v.groupBy(*names).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    first = first.select(*names, F.explode(F.array_distinct(ranks(F.col("n"))).cast("array<bigint>")).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("skip"), "n").where(F.col("rank").between(1, F.col("n")))
    todo, found = kept(first), []
    for _ in range(max_passes):
        found.append(todo.where("lo = hi").select(*names, "rank", F.col("lo").alias("_v")))
        leaf, todo = todo.where(f"lo < hi and n <= {LEAF_ROWS}"), todo.where(f"lo < hi and n > {LEAF_ROWS}")
        if not leaf.isEmpty():
            at = met(leaf).groupBy(*names, "rank").agg(F.first("skip").alias("skip"), F.array_sort(F.collect_list("_v")).alias("vs"))  # n values at most
            found.append(kept(at.select(*names, "rank", F.element_at("vs", (F.col("rank") - F.col("skip")).cast("int")).alias("_v"))))
        if todo.isEmpty():
            break
        cells = met(todo).groupBy(*names, "rank", "skip", _cell(F.col("_v"), F.col("lo"), F.col("hi")).alias("cell")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        w = Window.partitionBy(*names, "rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows
        cells = cells.withColumn("skip", F.col("skip") + F.coalesce(F.sum("n").over(w), F.lit(0)))
        todo = kept(cells.where((F.col("skip") < F.col("rank")) & (F.col("rank") <= F.col("skip") + F.col("n"))).select(*names, "rank", "lo", "hi", "skip", "n"))
    else:
        raise RuntimeError("ranks did not settle")
    out = reduce(DataFrame.unionByName, found)
    return out.select(*[F.col(n).alias(g) for g, n in zip(group, names)], "rank", F.col("_v").alias("value"))


def exact_percentiles(df: DataFrame, group: list[str], value: str, q: float, method: str = "exclusive", least: int = 0, name: str = "percentile") -> DataFrame:
    """A-27, A-28: (group.., n, percentile). ``exclusive`` stands at q (n + 1), ``inclusive`` at q (n - 1) + 1 of the sorted values, with
    linear interpolation; ends are the least and the largest value, which is also given for fewer than ``least`` values."""
    at = (lambda n: (n + 1) * F.lit(q)) if method == "exclusive" else (lambda n: (n - 1) * F.lit(q) + 1)

    def low(n: Column) -> Column:
        return F.least(F.greatest(F.floor(at(n)), F.lit(1)), n)

    def ranks(n: Column) -> Column:
        return F.array(low(n), F.least(low(n) + 1, n), n)

    n = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*group).agg(F.count("*").alias("n"))
    picked = select_ranks(df, group, value, ranks)
    on = reduce(lambda a, b: a & b, [n[g].eqNullSafe(picked[g]) for g in group], F.lit(True))
    both = n.join(picked, on).select(*[n[g] for g in group], "n", "rank", "value")

    def of(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("value")))

    got = both.groupBy(*group, "n").agg(of(low(F.col("n"))).alias("_a"), of(F.least(low(F.col("n")) + 1, F.col("n"))).alias("_b"), of(F.col("n")).alias("_top"))
    share = F.greatest(at(F.col("n")) - low(F.col("n")), F.lit(0.0))
    inner = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + share * (F.col("_b") - F.col("_a")))
    return got.select(*group, "n", F.when(F.col("n") < least, F.col("_top")).otherwise(inner).alias(name))


# Queries ---------------------------------------------------------------------------------------------------------


@R.query("ord_ntile", "W-03", "SELECT l_orderkey, l_linenumber, CAST(ntile(100) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS BIGINT) AS tile FROM lineitem")
def _(spark, d):
    """Hundredths of all lines by price."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return GlobalOrder(lines, ["l_extendedprice", "l_orderkey", "l_linenumber"]).tiles(100).drop("l_extendedprice")


@R.query("ord_ranks", "W-02 W-11", f"SELECT l_orderkey, l_linenumber, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, {_dec('percent_rank() OVER w', 6)} AS pr, {_dec('cume_dist() OVER w', 6)} AS cd FROM lineitem WINDOW w AS (ORDER BY l_quantity DESC)")
def _(spark, d):
    """Ranks of all lines by quantity, of which there are fifty: peers cross every part."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    r = GlobalOrder(lines, ["-l_quantity", "l_orderkey", "l_linenumber"], keys=1).ranked("rk", "dr", "pr", "cd")
    return r.select("l_orderkey", "l_linenumber", "rk", "dr", decimal("pr", 6).alias("pr"), decimal("cd", 6).alias("cd"))


@R.query("ord_running", "W-06 W-19", "SELECT event_id, CAST(sum(user_id) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS users, CAST(count(*) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM events")
def _(spark, d):
    """Totals so far of the whole stream of events."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id").withColumn("one", F.lit(1).cast("long"))
    return GlobalOrder(e, ["ts", "event_id"]).running(users="user_id", so_far="one").select("event_id", "users", "so_far")


@R.query("ord_frames", "W-04 W-07 W-19", f"SELECT event_id, lag(event_id, 2) OVER o AS back, lead(event_id) OVER o AS next, {_dec('avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)', 4)} AS mean FROM events WINDOW o AS (ORDER BY ts, event_id)")
def _(spark, d):
    """Neighbours in the whole stream, and means over a few."""
    e = table(spark, d, "events").select("event_id", "ts", "value")
    out = GlobalOrder(e, ["ts", "event_id"]).framed(2, 1, back=lambda w, o: F.lag("event_id", 2).over(o), next=lambda w, o: F.lead("event_id").over(o), mean=lambda w: F.avg("value").over(w))
    return out.select("event_id", "back", "next", decimal("mean", 4).alias("mean"))


@R.query("ord_percentiles", "A-26 A-27", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_dec('quantile_cont(l_extendedprice, 0.95)', 4)} AS p95 FROM lineitem GROUP BY ALL")
def _(spark, d):
    """Exact percentiles of groups of any size, by histograms of counts."""
    out = exact_percentiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.95, "inclusive")
    return out.select("l_returnflag", "l_linestatus", "n", decimal("percentile", 4).alias("p95"))


@R.query("rw_set_window_fields", "W-19", "SELECT event_id, CAST(sum(event_id) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s, lag(event_id) OVER (ORDER BY ts, event_id) AS prev, lead(event_id) OVER (ORDER BY ts, event_id) AS next FROM events WHERE event_type = 'click'")
def _(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'").select("event_id", "ts")
    o = GlobalOrder(e, ["ts", "event_id"])
    sums, near = o.running(s="event_id"), o.framed(1, 1, prev=lambda w, o: F.lag("event_id").over(o), next=lambda w, o: F.lead("event_id").over(o))
    return sums.drop("ts").join(near.drop("ts"), "event_id")


@R.query("rw_p95_exclusive", "A-28", "SELECT k, CAST(round(CAST(CASE WHEN n < 20 THEN hi ELSE a + (0.95 * (n + 1) - floor(0.95 * (n + 1))) * (b - a) END AS DECIMAL(38,12)), 6) AS DOUBLE) AS p95 FROM (SELECT k, n, hi, s[CAST(floor(0.95 * (n + 1)) AS INT)] AS a, coalesce(s[CAST(floor(0.95 * (n + 1)) AS INT) + 1], hi) AS b FROM (SELECT event_type AS k, count(*) AS n, max(value) AS hi, list_sort(list(value)) AS s FROM events GROUP BY 1) t) u")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("k"), "value")
    return exact_percentiles(e, ["k"], "value", 0.95, "exclusive", least=20).select("k", decimal("percentile", 6).alias("p95"))


QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
