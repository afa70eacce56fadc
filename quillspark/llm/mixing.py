"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all document rates r the mix takes the one closest to 1 in weighted relative entropy whose
words meet every source's target: r = min(2, exp(lambda_s * a)), a = size / (size + mean size of
the source).  The lambdas solve the convex dual, found by Newton iterations; each is one
aggregation over a histogram of document sizes.  Rates are then rounded into whole copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, dropped, fresh, shuffle_partitions, written

#: Sources by code point, null last, weigh these in turn.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words the mix takes, as a share of all words, and the most that a document or source is repeated.
SHARE, MOST = 1.5, 2
TOLERANCE, ITERATIONS = 1e-9, 80
#: Share of its target at which a source's words are left as they are, and units of a source that one
#: round of corrections changes at most.
NEAR, AT_ONCE = 0.0005, 1000
#: Units of one source and size that one task ranks.
CELL = 1 << 16

#: Sources, and cells and single documents of a plan, up to which their tables, some hundred bytes a
#: row, are broadcast.
BROADCAST_SOURCES, BROADCAST_CELLS = 50_000, 500_000

_WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: (source, source_size).  Adds ``target``: shares of ``share`` times all sizes by
    weight, where none exceeds ``most`` times its source's size and the excess is shared again.

    That is min(cap, level * weight) with one level: sources are capped in ascending order of
    cap / weight while the level of the rest stays above.  One row for each source."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(one) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    rows = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("all", F.sum("source_size").over(every) * F.lit(float(share)))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    capped_before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("capped", F.col("cap") / F.col("weight") * weight_left <= F.col("all") - capped_before)
    level = (F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0.0))) / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    return rows.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))).select("source", "source_size", "target")


def _tilt() -> Column:
    return F.col("size") / (F.col("size") + F.col("mean"))


def _rate(most: int) -> Column:
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * _tilt(), F.lit(50.0)))))


def _few(per_source: DataFrame) -> DataFrame:
    """A table of sources in fewer partitions than what it was gathered from."""
    return per_source.coalesce(max(1, shuffle_partitions(per_source.sparkSession) // 64))


def _hint(goals: DataFrame):
    """Broadcasts tables of sources if there are few."""
    return F.broadcast if goals.count() <= BROADCAST_SOURCES else (lambda d: d)


def solve(cells: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """goals (source, source_size, target, mean) with the dual solution ``lam`` and ``full`` (all
    documents taken ``most`` times).

    cells: (source, size, m, n).  A Newton step that leaves the bracket of the root is replaced
    by its middle, so the iteration converges for any sizes."""
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    hint = _hint(goals)
    state = written(goals.withColumns({"full": full, "lam": F.lit(0.0), "lo": F.lit(-60.0), "hi": 2.0 + F.log(F.lit(2.0 * most)) * (1 + F.col("mean"))}), "dual")
    for _ in range(ITERATIONS):
        met = cells.join(hint(state), cells.source.eqNullSafe(state.source)).drop(cells.source)
        take = F.col("n") * F.col("m") * F.col("size") * _rate(most)
        slope = F.when(F.col("lam") * _tilt() < F.log(F.lit(float(most))), take * _tilt()).otherwise(0.0)
        sums = _few(met.groupBy("source").agg(F.sum(take).alias("took"), F.sum(slope).alias("slope")))
        step = _few(state).join(hint(sums.withColumnRenamed("source", "s")), state.source.eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.coalesce("took", F.lit(0.0)) - F.col("target")
        step = step.withColumn("gap", F.when(F.col("full"), 0.0).otherwise(gap))
        step = step.withColumns({"lo": F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - F.col("gap") / F.col("slope")
        middle = (F.col("lo") + F.col("hi")) / 2
        done = F.abs("gap") <= TOLERANCE * F.greatest("target", F.lit(1.0))
        step = step.withColumn("lam", F.when(done, F.col("lam")).when((F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(middle))
        after = written(step.select(*goals.columns, "full", "lam", "lo", "hi", done.alias("done")), "dual")
        dropped(state)
        state = after
        if not state.where("not done").limit(1).count():
            return state.select(*goals.columns, "full", "lam")
    raise ArithmeticError(f"sources whose rates have not converged after {ITERATIONS} steps: {state.where('not done').select('source').limit(5).collect()}")


def _units(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """(doc_id, source, size, m): rows equal in these count as one unit of ``m`` rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    return written(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "units")


def _order(doc_id, source) -> Column:
    return F.xxhash64(F.lit("mix"), doc_id, source)


def _subs(n) -> Column:
    """Parts that a cell of ``n`` units is ranked in."""
    return F.ceil(n / F.lit(CELL))


def _plan(docs: DataFrame, doc_id: str, source: str, text: str, weights: tuple[float, ...], share: float, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, cells, changes): every unit with its copies before corrections; the parts of cells
    (source, size, m, n, rate, sub, last), where ``last`` (order, doc_id) is the last unit with a
    copy more; and the few corrected units (source, doc_id, size, m, by)."""
    units = _units(docs, doc_id, source, text)
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("rows"))
    goals = targets(totals.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "s").join(totals.select("source", "rows"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    goals = goals.withColumn("mean", F.greatest(F.col("source_size") / F.col("rows"), F.lit(1.0))).select("source", "source_size", "target", "mean")
    goals = written(_few(goals), "goals")
    cells = written(units.groupBy("source", "size", "m").agg(F.count("*").alias("n")), "cells")
    state = solve(cells, goals, most).withColumnRenamed("source", "s")
    rated = cells.join(state, cells.source.eqNullSafe(F.col("s"))).drop("s")
    rated = rated.withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(most)))
    rated = written(rated.select("source", "size", "m", "n", "source_size", "target", "rate"), "rates")

    # Units of a cell are alike; how many get one copy more follows from running sums of the
    # fractions, largest units first, so a source's error is at most half its largest unit.
    here = rated.withColumnsRenamed({"source": "s", "size": "z", "m": "k"})
    same = units.source.eqNullSafe(F.col("s")) & (units["size"] == F.col("z")) & (units.m == F.col("k"))
    dealt = units.join(here, same).drop("s", "z", "k").withColumn("order", _order("doc_id", "source"))
    dealt = dealt.withColumn("sub", F.pmod("order", _subs(F.col("n"))))
    subs = dealt.groupBy("source", "size", "m", "sub").agg(F.count("*").alias("c"), F.first("rate").alias("rate"))
    along = Window.partitionBy("source").orderBy(F.desc(F.col("size") * F.col("m")), F.desc("size"), "sub")
    part = F.col("c") * (F.col("rate") - F.floor("rate"))
    until = F.sum(part).over(along.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum(part).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    quota = subs.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("m").alias("k"), F.col("sub").alias("b"), (F.floor(until + 0.5) - F.floor(before + 0.5)).alias("more"))
    met = dealt.join(quota, dealt.source.eqNullSafe(F.col("s")) & (dealt["size"] == F.col("z")) & (dealt.m == F.col("k")) & (dealt["sub"] == F.col("b")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "m", "sub").orderBy("order", "doc_id"))
    out = met.withColumn("plus", rank <= F.col("more")).withColumn("copies", F.least(F.floor("rate") + F.col("plus").cast("int"), F.lit(most)).cast("int"))
    out = written(out.select("doc_id", "source", "size", "m", "n", "source_size", "target", "rate", "sub", "copies", "order", "plus"), "copies")
    last = F.max(F.when(F.col("plus"), F.struct("order", "doc_id"))).alias("last")
    parts = out.groupBy("source", "size", "m", "sub").agg(F.first("n").alias("n"), F.first("rate").alias("rate"), last)
    return out, parts, _changes(out, most, _hint(goals))


def decide(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, m, source_size, target, rate, copies) for each unit.

    A unit is the rows equal in id, source and size; each of its ``m`` rows is taken ``copies``
    times (0 to ``most``).  Null texts have size 0; a null source is a source; documents of size
    0 count nothing and are taken once.  Copies follow hashes of the id, so reruns agree.
    """
    with Scratch(docs.sparkSession) as scratch:
        out, _, changes = _plan(docs, doc_id, source, text, weights, share, most)
        return _corrected(scratch.keep(out), scratch.keep(changes)).select("doc_id", "source", "size", "m", "source_size", "target", "rate", "copies")


def _small(table: DataFrame, most: int):
    return F.broadcast if table.count() <= most else (lambda d: d)


def _corrected(out: DataFrame, changes: DataFrame) -> DataFrame:
    c = changes.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z"), F.col("m").alias("k"), "by")
    met = out.join(_small(c, BROADCAST_CELLS)(c), out.source.eqNullSafe(F.col("s")) & out.doc_id.eqNullSafe(F.col("d")) & (out["size"] == F.col("z")) & (out.m == F.col("k")), "left")
    return met.withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("s", "d", "z", "k", "by")


def _changes(out: DataFrame, most: int, hint) -> DataFrame:
    """(source, doc_id, size, m, by): units changed by one copy until every source is near its target
    or no change of a unit brings it nearer.

    A round finds each source's unit that leaves the least gap.  If that leaves more than half of the
    gap, all units are small against it, and as many units of that size are changed as fit, ``AT_ONCE``
    at most; so a gap is halved by each round, or a size is used up, and rounds are few."""
    took = written(_few(out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size") * F.col("m")).alias("took"), F.first("target").alias("goal"))), "took")
    none = out.select("source", "doc_id", "size", "m", F.lit(0).alias("by")).limit(0)
    changes = written(none, "changes")
    words_of = F.col("size") * F.col("m")
    while True:
        moved = changes.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("by") * words_of).alias("moved"))
        gap = F.col("goal") - F.col("took") - F.coalesce("moved", F.lit(0))
        gaps = took.join(hint(moved), took.source.eqNullSafe(F.col("s")), "left").withColumn("gap", gap).where(F.abs("gap") > NEAR * F.col("goal")).select(F.col("source").alias("s"), "gap")
        met = out.join(hint(gaps), out.source.eqNullSafe(F.col("s"))).drop("s")
        able = F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0) & (F.col("size") > 0)
        left = F.abs(F.abs("gap") - words_of)
        met = met.where(able & (left < F.abs("gap")))
        done = changes.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z"), F.col("m").alias("k"))
        met = met.join(hint(done), met.source.eqNullSafe(F.col("s")) & met.doc_id.eqNullSafe(F.col("d")) & (met["size"] == F.col("z")) & (met.m == F.col("k")), "left_anti")
        best = met.groupBy("source").agg(F.min(F.struct(left.alias("left"), "order", "doc_id", "size", "m", F.signum("gap").cast("int").alias("by"))).alias("b"), F.first(F.abs("gap")).alias("gap"))
        more = written(_few(best.select("source", "b.doc_id", "b.size", "b.m", "b.by", F.floor(F.col("gap") / F.col("b.size") / F.col("b.m")).alias("fit"))), "changes")
        found = more.agg(F.count("*"), F.coalesce(F.max("fit"), F.lit(0))).first()
        if not found[0]:
            return changes
        picked = more.where("fit <= 1").select(changes.columns)
        if found[1] > 1:
            cell = more.where("fit > 1").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("m").alias("k"), "by", "fit")
            alike = met.join(hint(cell), met.source.eqNullSafe(F.col("s")) & (met["size"] == F.col("z")) & (met.m == F.col("k")))
            n = F.row_number().over(Window.partitionBy("source").orderBy("order", "doc_id"))
            picked = picked.unionByName(alike.withColumn("n", n).where(F.col("n") <= AT_ONCE).where("n <= fit").select(changes.columns))
        changes = written(_few(changes.unionByName(picked)), "changes")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` repeated as often as :func:`decide` says.

    A row's copies follow from its cell and its hash, so texts stay where they are: cells of
    single rows, and the few documents that are corrected or repeated, are broadcast.  Beyond the
    bound of either table rows meet their copies by shuffle.  Columns are those of ``docs``,
    whatever their names.  Nulls, texts without words and repeated rows are as in :func:`decide`;
    an empty table stays empty."""
    with Scratch(docs.sparkSession) as scratch:
        units, parts, changes = _plan(docs, doc_id, source, text, weights, share, most)
        cells = parts.where("m = 1").groupBy("source", "size").agg(F.first("n").alias("n"), F.first("rate").alias("rate"), F.map_from_entries(F.collect_list(F.struct("sub", "last"))).alias("by_sub"))
        lasts = F.transform(F.sequence(F.lit(0).cast("bigint"), _subs(F.col("n")) - 1), lambda i: F.element_at("by_sub", i))
        cells = scratch.keep(written(cells.select("source", "size", "n", "rate", lasts.alias("lasts")), "mix_cells"))
        every = _corrected(units, changes)
        touched = changes.select(F.col("source").alias("s"), F.col("doc_id").alias("d")).distinct()
        single = every.where("m > 1").unionByName(every.join(_small(touched, BROADCAST_CELLS)(touched), every.source.eqNullSafe(F.col("s")) & every.doc_id.eqNullSafe(F.col("d")), "left_semi").where("m = 1"))
        single = scratch.keep(written(single.select("doc_id", "source", "size", "copies"), "mix_single"))
        small = max(cells.count(), single.count()) <= BROADCAST_CELLS
        if not small:
            single = scratch.keep(written(every.select("doc_id", "source", "size", "copies"), "mix_units"))
    size, order, d, s, z, copies, cs, cz, n, rate, lasts, copy = fresh(docs.columns, "size", "order", "d", "s", "z", "copies", "cs", "cz", "n", "rate", "lasts", "copy")
    hint = F.broadcast if small else (lambda t: t)
    own = single.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z), F.col("copies").alias(copies))
    met = docs.withColumn(size, words(F.col(text))).join(hint(own), F.col(doc_id).eqNullSafe(F.col(d)) & F.col(source).eqNullSafe(F.col(s)) & (F.col(size) == F.col(z)), "left" if small else "inner")
    times = F.col(copies)
    if small:
        named = cells.select(F.col("source").alias(cs), F.col("size").alias(cz), F.col("n").alias(n), F.col("rate").alias(rate), F.col("lasts").alias(lasts))
        met = met.join(F.broadcast(named), F.col(source).eqNullSafe(F.col(cs)) & (F.col(size) == F.col(cz)), "left").withColumn(order, _order(F.col(doc_id), F.col(source)))
        last = F.get(lasts, F.pmod(F.col(order), _subs(F.col(n))).cast("int"))
        plus = F.struct(F.col(order).alias("order"), F.col(doc_id).alias("doc_id")) <= last
        times = F.coalesce(times, F.least(F.floor(rate) + F.coalesce(plus, F.lit(False)).cast("int"), F.lit(most)).cast("int"))
    met = met.withColumn(copies, times).where(F.col(copies) > 0)
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def account(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, rate, copies.

    Nulls, repeated rows and empty tables are as in :func:`decide`; other columns are left out."""
    plan = decide(docs)
    rows = plan.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "source", "rate", "copies")
