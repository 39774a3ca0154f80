"""Exact quantiles and exact global ranks without one task seeing all values."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.session import reuse

ACCURACY = 10_000
SLACK = 3 / ACCURACY
FINAL_VALUES = 100_000
BINS = 1 << 15  # of all intervals together
EVEN = 16  # an interval is cut into equal widths again while a bin holds at most this part of it
SKETCH_SIZE = 4096
SKETCH_SLACK = 0.002


@dataclass
class _Interval:
    """Open interval ``(low, high)`` of one column and the order statistics (0-based) in it."""

    column: str
    before: int  # rows at or below low
    inside: int  # rows strictly between low and high
    ranks: set[int]
    low: float | None = None
    high: float | None = None
    # Finite values around all finite values inside, if equal widths between them are expected to cut the interval well.
    least: float | None = None
    most: float | None = None

    def holds(self, v: Column) -> Column:
        found = v.isNotNull()
        if self.low is not None:
            found = found & (v > self.low)
        if self.high is not None:
            found = found & (v < self.high)
        return found


def _brackets(values: DataFrame, intervals: list[_Interval]) -> dict[str, list[float]]:
    """Column -> interval ends and approximate values just below and above each wanted rank."""
    aggs, cuts = [], {}
    for i, t in enumerate(intervals):
        # The slack covers a rank and the next one, which interpolation needs as well.
        at = [(k - t.before) / t.inside for k in t.ranks if k - 1 not in t.ranks]
        probs = sorted({min(1.0, max(0.0, p + d)) for p in at for d in (-SLACK, SLACK)})
        v = F.col(f"`{t.column}`")
        inside = F.when(t.holds(v), v)
        aggs.append(F.percentile_approx(inside, probs, ACCURACY).alias(f"t{i}"))
    row = values.agg(*aggs).first()
    for i, t in enumerate(intervals):
        ends = [x for x in (t.low, t.high) if x is not None]
        cuts.setdefault(t.column, set()).update(row[f"t{i}"], ends)
    return {c: sorted(x) for c, x in cuts.items()}


def _narrow(
    values: DataFrame, intervals: list[_Interval], cuts: dict[str, list[float]], known: dict
) -> list[_Interval]:
    """One counting pass; settles ranks that fall on a cut, shrinks the other intervals.

    The counts are exact, so a poor approximation costs another pass, not a wrong result.
    Rows equal to a cut leave the intervals: a value held by a third of all rows
    cannot keep one large.
    """
    # Place of a value among the sorted cuts: 2i between cuts i and i + 1, 2i + 1 on cut i + 1.
    names, width = list(cuts), 2 * max(map(len, cuts.values())) + 1
    cells = [F.when(F.col(f"`{c}`").isNotNull(), _place(F.col(f"`{c}`"), cuts[c], i * width)) for i, c in enumerate(names)]
    long = values.select(F.explode(F.array(*cells)).alias("cell")).where("cell IS NOT NULL")
    counts = [(names[r["cell"] // width], r["cell"] % width, r["count"]) for r in long.groupBy("cell").count().collect()]
    smaller: dict[tuple, _Interval] = {}
    for c, edges in cuts.items():
        ranks = sorted({k for t in intervals if t.column == c for k in t.ranks})
        start = 0
        for place, n in sorted(x[1:] for x in counts if x[0] == c):
            here = [k for k in ranks if start <= k < start + n]
            if here and place % 2:
                known.update({(c, k): edges[place // 2] for k in here})
            elif here:
                low = edges[place // 2 - 1] if place else None
                high = edges[place // 2] if place // 2 < len(edges) else None
                ends = (low, high) if None not in (low, high) and math.isfinite(low) and math.isfinite(high) else (None, None)
                smaller[c, place] = _Interval(c, start, n, set(here), low, high, *ends)
            start += n
    return list(smaller.values())


def _place(v: Column, edges: list[float], first: int) -> Column:
    """The place of ``v`` among sorted edges, counted from ``first``; halving needs few comparisons."""
    if not edges:
        return F.lit(first)
    i = len(edges) // 2
    below, above = _place(v, edges[:i], first), _place(v, edges[i + 1 :], first + 2 * i + 2)
    return F.when(v < edges[i], below).when(v == edges[i], F.lit(first + 2 * i + 1)).otherwise(above)


def _inside(values: DataFrame, intervals: list[_Interval], cell: Callable[[int, _Interval, Column], Column]) -> DataFrame:
    """``(cell, v)`` of the values inside the intervals, of which those of one column do not overlap."""
    cells: dict[str, Column] = {}
    for i, t in enumerate(intervals):
        v = F.col(f"`{t.column}`")
        found = F.struct(cell(i, t, v).alias("cell"), v.alias("v"))
        cells[t.column] = cells[t.column].when(t.holds(v), found) if t.column in cells else F.when(t.holds(v), found)
    return values.select(F.explode(F.array(*cells.values())).alias("x")).select("x.*").where("cell IS NOT NULL")


def _finish(values: DataFrame, intervals: list[_Interval], known: dict) -> None:
    """Read the few values left inside each interval."""
    counts: dict[int, list[tuple]] = {}
    for r in _inside(values, intervals, lambda i, t, v: F.lit(i)).groupBy("cell", "v").count().collect():
        counts.setdefault(r["cell"], []).append((r["v"], r["count"]))
    for i, t in enumerate(intervals):
        start = t.before
        for value, n in sorted(counts.get(i, [])):
            known.update({(t.column, k): value for k in t.ranks if start <= k < start + n})
            start += n


def _scale(t: _Interval, bins: int) -> float | None:
    """Bins per half unit between an interval's ends, or None if these cannot be told apart or are not known."""
    if t.least is None or not t.most / 2 - t.least / 2 > 0:
        return None
    scale = bins / (t.most / 2 - t.least / 2)
    return scale if math.isfinite(scale) else None


def _binned(values: DataFrame, intervals: list[_Interval], known: dict) -> list[_Interval]:
    """One pass that counts bins of equal width in each interval; returns the bins of ranks still open.

    A bin's bounds are its own least and greatest value, so that rounding in its number
    does not matter: the number never falls as the value grows. A bin of one value is
    settled, a bin with much of its interval is left to the sketches.
    """
    bins = max(2, BINS // len(intervals))

    def cell(i: int, t: _Interval, v: Column) -> Column:
        # Halves: the distance between two numbers may not be one.
        at = (v / 2 - F.lit(t.least / 2)) * F.lit(_scale(t, bins))
        return F.least(F.greatest(at, F.lit(0.0)), F.lit(bins - 1.0)).cast("int") + F.lit(i * bins)

    found: dict[int, list[tuple]] = {}
    counted = _inside(values, intervals, cell).groupBy("cell").agg(F.count("*"), F.min("v"), F.max("v"))
    for number, n, least, most in sorted(map(tuple, counted.collect())):
        found.setdefault(number // bins, []).append((n, least, most))
    open_ = []
    for i, t in enumerate(intervals):
        start, own = t.before, found.get(i, [])
        for j, (n, least, most) in enumerate(own):
            here = {k for k in t.ranks if start <= k < start + n}
            if here and least == most:
                known.update({(t.column, k): least for k in here})
            elif here:
                low = own[j - 1][2] if j else t.low
                high = own[j + 1][1] if j + 1 < len(own) else t.high
                even = n * EVEN <= t.inside and math.isfinite(least) and math.isfinite(most)
                open_.append(_Interval(t.column, start, n, here, low, high, *((least, most) if even else (None, None))))
            start += n
    return open_


def _numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])


def quantile_sketches(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``(*by, column, n, sketch)``: number of values and KLL sketch of each column in each part of the table.

    A part is what arrives together, as a day; ``by`` names it. Rows of later parts are
    added by ``unionByName``: earlier parts are not read again. A sketch takes some
    75 kB whatever the size of its part, and is merged in the tasks before the shuffle.
    """
    keys = [F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)]
    values = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)]
    sketched = df.select(*keys, *values).groupBy(*[f"_by{i}" for i in range(len(by))]).agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count(f"_v{i}").alias("n"),
            F.kll_sketch_agg_double(f"_v{i}", F.lit(SKETCH_SIZE)).alias("sketch"),
        ).alias(f"_s{i}") for i, c in enumerate(columns)
    ])
    parts = sketched.select(*[F.col(f"_by{i}").alias(c) for i, c in enumerate(by)],
                            F.explode(F.array(*[f"_s{i}" for i in range(len(columns))])).alias("_s"))
    return parts.select(*[f"`{c}`" for c in by], "_s.*")


def _ranks(n: int, probs: list[float]) -> set[int]:
    """The order statistics (0-based) of ``n`` values that interpolation at ``probs`` reads."""
    below = {math.floor(p * (n - 1)) for p in probs}
    return below | {min(k + 1, n - 1) for k in below}


def _interpolated(known: dict, c: str, n: int, p: float) -> float | None:
    if not n:
        return None
    at = p * (n - 1)
    k = math.floor(at)
    low, frac = known[c, k], at - k
    return low if frac == 0 else low + (known[c, k + 1] - low) * frac


def _merged(sketches: DataFrame, columns: list[str], probs: list[float]) -> tuple[dict, dict]:
    """Column -> number of values, and column -> approximate values on both sides of each quantile."""
    # Unlike an approximate percentile, a KLL sketch is off by some 0.0007 of the ranks in most cases.
    ends = [min(1.0, max(0.0, p + d)) for p in probs for d in (-SKETCH_SLACK, SKETCH_SLACK)]
    merged = sketches.where(F.col("column").isin(columns)).groupBy("column").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("sketch"))
    near = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(ends)))
    found = {r["column"]: r for r in merged.select("column", "n", near.alias("near")).collect()}
    missing = [c for c in columns if c not in found]
    if missing and found:
        raise ValueError(f"no sketches of {', '.join(missing)}")
    sizes = {c: found[c]["n"] if c in found else 0 for c in columns}
    return sizes, {c: list(zip(found[c]["near"][::2], found[c]["near"][1::2])) for c in columns if sizes[c]}


def _count_and_read(
    values: DataFrame, sizes: dict[str, int], brackets: dict[str, list[tuple[float, float]]], probs: list[float], known: dict
) -> list[_Interval]:
    """One pass that counts around the brackets and, where they are expected to hold few
    values, brings these too; returns the intervals of ranks still open.
    """
    expected = sum(min(1, 2 * SKETCH_SLACK * len(b)) * sizes[c] for c, b in brackets.items())
    cells, cuts, read = [], {}, {}
    for c, pairs in brackets.items():
        edges = cuts[c] = sorted({e for pair in pairs for e in pair})
        # Even places lie between cuts; those inside a bracket may hold a wanted rank.
        read[c] = [2 * i for i in range(1, len(edges)) if any(lo <= edges[i - 1] and edges[i] <= hi for lo, hi in pairs)]
        if expected > FINAL_VALUES:
            read[c] = []
        v = F.col(f"`{c}`")
        place = sum(((v > e).cast("int") + (v >= e).cast("int") for e in edges), F.lit(0))
        cells.append(F.struct(F.lit(c).alias("c"), place.alias("place"), F.when(place.isin(read[c]), v).alias("v")))
    long = values.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("place IS NOT NULL")
    counts = sorted(((r["c"], r["place"], r["v"], r["count"]) for r in long.groupBy("c", "place", "v").count().collect()),
                    key=lambda r: (r[0], r[1], r[2] is not None, r[2]))
    open_ = []
    for c, edges in cuts.items():
        ranks, start = _ranks(sizes[c], probs), 0
        for _, place, v, n in (r for r in counts if r[0] == c):
            here = {k for k in ranks if start <= k < start + n}
            if here and (place % 2 or v is not None):
                known.update({(c, k): edges[place // 2] if place % 2 else v for k in here})
            elif here:
                low = edges[place // 2 - 1] if place else None
                high = edges[place // 2] if place // 2 < len(edges) else None
                open_.append(_Interval(c, start, n, here, low, high))
            start += n
        if start != sizes[c]:
            raise ValueError(f"the sketches count {sizes[c]} values of {c}, the table {start}")
    return open_


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], sketches: DataFrame | None = None
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, per column, in a few column scans.

    Runs jobs when called: counts in bins of equal width between the extremes cut the
    interval of each rank, again and again, until it holds few values, which are read.
    Where the values are not spread evenly enough for that, an approximate sketch cuts the
    interval to about 1/1000 and exact counts confirm it; it costs several times as much.
    The driver receives at most FINAL_VALUES values or BINS bins at a time, for all intervals together.

    ``sketches`` (of ``quantile_sketches``, for exactly the rows of ``df``) save the first
    scan; up to about FINAL_VALUES / (2 * SKETCH_SLACK) / len(probs) rows the counting
    pass also brings the values, so that it is the only one. Their counts are checked
    against the table's. The result is the same with and without them.
    """
    values = _numbers(df, columns)
    known: dict[tuple[str, int], float] = {}
    if sketches is not None:
        n, pairs = _merged(sketches, columns, probs)
        if not pairs:
            # Nothing is sketched: an empty table, or one that the sketches do not cover.
            counted = values.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first()
            if any(counted):
                raise ValueError("the sketches hold no values, the table does")
        waiting = _count_and_read(values, n, pairs, probs, known) if pairs else []
    else:
        n, waiting = _bracketed(values, columns, probs)
    while waiting:
        most = FINAL_VALUES // len(waiting)
        small = [t for t in waiting if t.inside <= most]
        waiting = [t for t in waiting if t.inside > most]
        if small:
            _finish(values, small, known)
        even = [t for t in waiting if _scale(t, BINS)]
        uneven = [t for t in waiting if not _scale(t, BINS)]
        waiting = _binned(values, even, known) if even else []
        if uneven:
            waiting += _narrow(values, uneven, _brackets(values, uneven), known)
    return {c: [_interpolated(known, c, n[c], p) for p in probs] for c in columns}


def _bracketed(values: DataFrame, columns: list[str], probs: list[float]) -> tuple[dict, list[_Interval]]:
    """One scan: the number of values per column, and an interval around all ranks."""
    finite = {c: F.when(F.abs(F.col(f"`{c}`")) < math.inf, F.col(f"`{c}`")) for c in columns}
    row = values.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.min(finite[c]).alias(f"least{i}"), F.max(finite[c]).alias(f"most{i}"))]).first()
    n = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    return n, [_Interval(c, 0, n[c], _ranks(n[c], probs), None, None, row[f"least{i}"], row[f"most{i}"])
               for i, c in enumerate(columns) if n[c]]


def global_rank(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """Add the 1-based rank over the whole table; ``order_by`` must be unique per row.

    Range partitions are sorted and kept with their local positions; only one count
    per partition is summed up. A tie group of any size is split by the later keys.
    """
    local = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        # Upper bits: partition, in range order; lower 33 bits: position inside it.
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumns({"_part": F.shiftright("_id", 33), "_pos": F.col("_id").bitwiseAND((1 << 33) - 1)})
        .drop("_id")
    )
    local = reuse(local)
    sizes = {r["_part"]: r["count"] for r in local.groupBy("_part").count().collect()}
    offsets, seen = [], 0
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(seen)
        seen += sizes.get(part, 0)
    if not offsets:
        return local.withColumn(name, F.lit(0).cast("long")).drop("_part", "_pos")
    start = F.element_at(F.lit(offsets).cast("array<bigint>"), (F.col("_part") + 1).cast("int"))
    return local.withColumn(name, start + F.col("_pos") + 1).drop("_part", "_pos")
