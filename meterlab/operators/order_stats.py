"""Exact order statistics for groups of any size.

``percentile`` and ordered windows bring a whole group into one task.  That is
fine for one household's hourly series (the calendar bounds it) but not for
"all rows of a season".

:func:`exact_quantiles` narrows brackets around the wanted places, per group:

1.  A mergeable sketch per group gives two values on either side of each place;
    groups of a few thousand rows take their minimum and maximum.
2.  One pass counts the rows below each bracket and the copies of the values in
    it; everything else collapses map-side into one row per group.  The counts
    prove the brackets right; if one isn't, all are widened.
3.  Brackets that still hold many distinct values are cut at the quantiles of
    these and the part with the place is kept, until few are left, which are
    read as one bounded array per place.

Groups may be of any size and lie anywhere on the value axis; the sketch only
decides how much is left to count.  No window orders values.

:func:`value_positions` (ranks) needs every distinct value and sorts cell by
cell of the value axis.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlab.sources.stages import materialise

CELLS = 256
STRIDE = 16
SKETCH_ACCURACY = 2000
#: Of the brackets: the sketch's accuracy, rows up to which a group is its own bracket, cuts of a bracket, and distinct
#: values at the end of narrowing.
ACCURACY, SMALL, STRIDES, FEW = 1000, 4000, 64, 20000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def attach_stats(rows: DataFrame, stats: DataFrame, keys: Sequence[str], salts: int = 16) -> DataFrame:
    """Left join one-row-per-group statistics to rows that may be badly skewed.

    The row side is salted by a hash of its own columns and the statistics are
    replicated per salt, so a hot group is spread over ``salts`` shuffle
    partitions (and adaptive execution may split those further, because nothing
    downstream relies on this partitioning).  If the statistics turn out small,
    Spark's own size check replaces the shuffle by a broadcast.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    copies = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return null_safe_join(salted, copies, [*keys, "__salt"], "left").drop("__salt")


def row_numbers(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """0-based row numbers in the order of ``order``, without a one-task sort.

    The range-partitioned rows are written once (bounds differ between evaluations); then only one
    count per partition is summed in one task and sent back.
    """
    rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")
    offsets = F.broadcast(counts.select("__p", before.alias("__base")))  # bound: one row per partition
    return rows.join(offsets, part == F.col("__p")).withColumn(
        name, F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__p", "__base")


def _edges_upto(value: Column, edge: Callable[[int], Column], low: int, high: int) -> Column:
    """How many of the ascending edges are <= value: a balanced CASE tree, compiled with the stage."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(value < edge(mid), _edges_upto(value, edge, low, mid)).otherwise(
        _edges_upto(value, edge, mid + 1, high))


def _present(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    rows = df.select(*by, F.col(value).cast("double").alias("value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _celled(rows: DataFrame, cells: int) -> DataFrame:
    """Add ``__cell`` to rows with a ``value`` column; ``cells`` is a multiple of STRIDE.

    The search goes through every STRIDE-th edge first, then within that stride.
    """
    probs = [i / cells for i in range(1, cells)]
    edges = rows.agg(F.percentile_approx("value", probs, SKETCH_ACCURACY).alias("edges")).scalar()
    value, at = F.col("value"), F.col("__edges")
    hop = _edges_upto(value, lambda i: F.get(at, F.lit((i + 1) * STRIDE - 1)), 0, cells // STRIDE - 1) * STRIDE
    cell = F.col("__hop") + _edges_upto(value, lambda i: F.get(at, F.col("__hop") + i), 0, STRIDE - 1)
    return (rows.withColumn("__edges", edges).withColumn("__hop", hop).withColumn("__cell", cell)
            .drop("__edges", "__hop"))


def _cell_sums(celled: DataFrame, by: Sequence[str], copies: Column) -> DataFrame:
    """(by, __cell, __here, __least, __most, __before, total), at most CELLS rows per group."""
    sums = celled.groupBy(*by, "__cell").agg(
        F.sum(copies).alias("__here"), F.min("value").alias("__least"), F.max("value").alias("__most"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = F.sum("__here").over(group.orderBy("__cell"))
    return sums.withColumns({
        "__before": upto - F.col("__here"),
        "total": F.sum("__here").over(group),
    })


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-NULL values per group with their number of copies."""
    return _present(df, value, by).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("copies"))


def value_positions(df: DataFrame, value: str, by: Sequence[str] = (), cells: int = CELLS) -> DataFrame:
    """Distinct non-NULL values with their place in the order of their group.

    Returns ``(*by, value, copies, below, total)`` where ``below`` counts the
    rows of the group with a smaller value.
    """
    by = list(by)
    celled = _celled(value_counts(df, value, by), cells)
    sums = _cell_sums(celled, by, F.col("copies")).drop("__here", "__least", "__most")
    placed = null_safe_join(celled, sums, [*by, "__cell"])
    inside = Window.partitionBy(*by, "__cell").orderBy("value")
    running = F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("below", F.col("__before") + running - F.col("copies")).select(
        *by, "value", "copies", "below", "total")


def _around(rows: DataFrame, by: list[str], probs: Sequence[float], margin: float) -> DataFrame:
    """One row per group: n and, for each place, a bracket [__lo<j>, __hi<j>] that holds it as far as a sketch can tell."""
    ends = [(p - margin, p + margin) for p in probs]
    sides = [min(max(x, 0.0), 1.0) for pair in ends for x in pair]
    aggs = [F.count(F.lit(1)).alias("n"), F.min("value").alias("__min"), F.max("value").alias("__max"),
            F.percentile_approx("value", sides, ACCURACY).alias("__at")]
    found = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    small = F.col("n") <= SMALL
    cols = []
    for j, (low, high) in enumerate(ends):
        cols.append(F.when(small | F.lit(low <= 0), F.col("__min")).otherwise(F.get("__at", F.lit(2 * j))).alias(f"__lo{j}"))
        cols.append(F.when(small | F.lit(high >= 1), F.col("__max")).otherwise(F.get("__at", F.lit(2 * j + 1))).alias(f"__hi{j}"))
    return found.select(*by, "n", *cols)


def _narrowed(inside: DataFrame, places: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cut the values of each bracket at their quantiles and keep the part that holds its places."""
    edges = inside.groupBy(*keys).agg(F.percentile_approx("value", [i / STRIDES for i in range(1, STRIDES)], ACCURACY).alias("__e"))
    celled = null_safe_join(inside, edges, keys).withColumn("__cell", F.size(F.filter("__e", lambda e: e <= F.col("value")))).drop("__e")
    sums = celled.groupBy(*keys, "__cell").agg(F.sum("copies").alias("h")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("__cell").alias("c"), "h"))).alias("__s"))  # at most STRIDES entries
    placed = null_safe_join(places, sums, keys)
    zero = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0).cast("bigint").alias("before"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc, x):
        upto = acc["seen"] + x["h"]
        holds = lambda k: (acc["seen"] <= k) & (k < upto)
        starts = holds(F.col("__low") - F.col("__below"))
        return F.struct(upto.alias("seen"), F.when(starts, acc["seen"]).otherwise(acc["before"]).alias("before"),
                        F.when(starts, x["c"]).otherwise(acc["first"]).alias("first"),
                        F.when(holds(F.col("__high") - F.col("__below")), x["c"]).otherwise(acc["last"]).alias("last"))

    cut = placed.withColumn("__f", F.aggregate("__s", zero, step))
    places = cut.select(*keys, "n", "__low", "__high", (F.col("__below") + F.col("__f.before")).alias("__below"))
    kept = null_safe_join(celled, cut.select(*keys, F.col("__f.first").alias("__a"), F.col("__f.last").alias("__z")), keys)
    return materialise(kept.where(F.col("__cell").between(F.col("__a"), F.col("__z"))).select(*keys, "value", "copies")), materialise(places)


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
                    few: int = FEW) -> DataFrame:
    """Exact interpolated quantiles (the usual (n-1)p rule), one row per group.

    ``probs`` maps output column names to probabilities; ``few`` is how many
    distinct values may be left around a place.
    """
    by, names = list(by), list(probs)
    rows, margin, last = _present(df, value, by), 2.5 / ACCURACY, len(names)
    keys = [*by, "__j"]
    while True:
        around = materialise(_around(rows, by, list(probs.values()), margin))
        ends = [f"__{side}{j}" for j in range(last) for side in ("lo", "hi")]
        near = with_stats(rows, around, by, ends)
        within = [F.col("value").between(F.col(f"__lo{j}"), F.col(f"__hi{j}")) for j in range(last)]
        any_of = within[0]
        for w in within[1:]:
            any_of = any_of | w
        seen = materialise(near.withColumn("__v", F.when(any_of, F.col("value"))).groupBy(*by, "__v").agg(
            F.count(F.lit(1)).alias("copies"), *[F.count_if(F.col("value") < F.col(f"__lo{j}")).alias(f"__b{j}") for j in range(last)]))
        sums = [F.sum(f"__b{j}").alias(f"__b{j}") for j in range(last)]
        below = seen.groupBy(*by).agg(*sums) if by else seen.agg(*sums)
        facts = with_stats(around, below, by, [f"__b{j}" for j in range(last)])
        place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
        listed = F.array(*[F.struct(F.lit(j).alias("__j"), F.floor(place(p)).alias("__low"), F.ceil(place(p)).alias("__high"),
                                    F.col(f"__b{j}").alias("__below")) for j, p in enumerate(probs.values())])
        places = facts.where("n > 0").select(*by, "n", F.explode(listed).alias("p")).select(*by, "n", "p.*")
        values = with_stats(seen.where(F.col("__v").isNotNull()), around, by, ends).withColumnRenamed("__v", "value")
        inside = values.select(*by, "value", "copies", F.explode(F.array(*[F.when(w, F.lit(j)) for j, w in enumerate(within)])).alias("__j")).where(
            F.col("__j").isNotNull())
        held = inside.groupBy(*keys).agg(F.sum("copies").alias("__in"), F.count(F.lit(1)).alias("__distinct"))
        checked = null_safe_join(places, held, keys, "left")
        proof = checked.agg(F.max(F.when((F.col("__below") <= F.col("__low")) & (F.col("__high") < F.col("__below") + F.col("__in")), 0).otherwise(1)).alias("wrong"),
                            F.max("__distinct").alias("most")).first()
        if not proof["wrong"]:
            break
        margin *= 8  # at 1 and more brackets are whole groups
    most = proof["most"] or 0
    while most > few:
        inside, places = _narrowed(inside, places, keys)
        most, before = inside.groupBy(*keys).count().agg(F.max("count")).first()[0], most
        if most >= before:
            break
    zero = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

    def step(acc, x):
        upto = acc["seen"] + x["copies"]
        holds = lambda k: (acc["seen"] <= k) & (k < upto)
        return F.struct(upto.alias("seen"), F.when(holds(F.col("__low") - F.col("__below")), x["value"]).otherwise(acc["lo"]).alias("lo"),
                        F.when(holds(F.col("__high") - F.col("__below")), x["value"]).otherwise(acc["hi"]).alias("hi"))

    lists = inside.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("value", "copies"))).alias("__a"))  # ``few`` entries
    found = null_safe_join(places, lists, keys).withColumn("__f", F.aggregate("__a", zero, step))
    frac = F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("__j") + 1) * (F.col("n") - 1) - F.col("__low")
    found = found.withColumn("__q", F.col("__f.lo") + frac * (F.col("__f.hi") - F.col("__f.lo")))
    picks = [F.max(F.when(F.col("__j") == j, F.col("__q"))).alias(name) for j, name in enumerate(names)]
    return found.groupBy(*by).agg(*picks) if by else found.agg(*picks)


def exact_fences(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Quartiles, and what lies beyond ``k`` interquartile ranges of them, per group.

    Returns ``(*by, n, q1, median, q3, lower_whisker, upper_whisker, n_outliers)``.
    """
    by, rows = list(by), _present(df, value, by)
    quart = materialise(exact_quantiles(df, value, {"q1": .25, "median": .5, "q3": .75}, by))
    reach = k * (F.col("q3") - F.col("q1"))
    limits = quart.withColumns({"__low": F.col("q1") - reach, "__high": F.col("q3") + reach})
    names = ["q1", "median", "q3", "__low", "__high"]
    v = F.col("value")
    ok = v.between(F.col("__low"), F.col("__high"))
    aggs = [F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in names[:3]], F.min(F.when(ok, v)).alias("lower_whisker"),
            F.max(F.when(ok, v)).alias("upper_whisker"), F.count_if(~ok).alias("n_outliers")]
    fenced = with_stats(rows, limits, by, names)
    return fenced.groupBy(*by).agg(*aggs) if by else fenced.agg(*aggs)


def population_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank",
                    descending: bool = True, cells: int = CELLS) -> DataFrame:
    """Rank with shared minimum for ties, without a single-task sort.

    NULL values get a NULL rank.
    """
    by = list(by)
    places = value_positions(df, value, by, cells)
    place = (F.col("total") - F.col("below") - F.col("copies") + 1) if descending else F.col("below") + 1
    places = places.select(*by, F.col("value").alias(value), place.cast("bigint").alias(name))
    return null_safe_join(df, places, [*by, value], "left")  # places are as many as values: copies per salt would multiply them



def with_stats(rows: DataFrame, stats: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add the ``names`` columns of per-group statistics (one table-wide row if ``by`` is empty)."""
    if by:
        return attach_stats(rows, stats.select(*by, *names), list(by))
    packed = stats.select(F.struct(*names).alias("s")).scalar()
    return rows.withColumn("__s", packed).select(
        *rows.columns, *[F.col("__s").getField(c).alias(c) for c in names])
