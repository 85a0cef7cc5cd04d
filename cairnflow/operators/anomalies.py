"""Readings that are not credible for their source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .chunks import chunked

SPIKE = 3  # readings of a spike at most
STUCK = 10  # equal successive readings that are stuck
SIDE = 4  # readings on either side that a spike is compared with
HALO = 64
BLOCK_H = 6  # hours whose sketches are merged where an hour of day has few readings
FENCE = 7.0  # interquartile ranges beyond the quartiles
LEAST = 0.004  # interquartile range at least, as a share of the level
CALMEST = 0.8  # least interquartile range of a context, as a share of that of all hours
STEEP = 3.0  # times the steps of its calmer side that a spike must jump
#: Fences of at most so many series and hours are sent to all tasks; more are joined by a shuffle.
SMALL_MAP = 20_000
FEW = 48  # readings that a context needs for quartiles of its own


def _shifted(v: np.ndarray, group: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Columns v[i + o] for each offset, NaN beyond the group."""
    at = np.arange(len(v))[:, None] + np.array(offsets)[None, :]
    inside = (at >= 0) & (at < len(v))
    at = np.clip(at, 0, max(len(v) - 1, 0))
    return np.where(inside & (group[at] == group[:, None]), v[at], np.nan)


def _median(block: np.ndarray) -> np.ndarray:
    """Median of each row without NaN; NaN for a row of NaN."""
    ordered = np.sort(block, axis=1)
    n = (~np.isnan(block)).sum(axis=1)
    rows = np.arange(len(block))
    low, high = np.maximum(n - 1, 0) // 2, np.minimum(n // 2, block.shape[1] - 1)
    return (ordered[rows, low] + ordered[rows, high]) / 2


def features(group: np.ndarray, v: np.ndarray, possible: np.ndarray) -> dict[str, np.ndarray]:
    """Of readings in order of group and time: ``level``, ``jump`` (by which it leaves and returns as part of a spike) and ``stuck``.

    Level and jump are those among possible readings; an impossible one has the level of the possible one before it, or
    else after it, and the distance to it as jump.
    """
    n = len(v)
    level, jump = np.full(n, np.nan), np.zeros(n)
    keep = np.flatnonzero(possible)
    x, g = v[keep], group[keep]
    if len(x):
        span = SIDE + SPIKE
        wide = _shifted(x, g, list(range(-span, span + 1)))  # column span + o holds offset o
        level[keep] = _median(wide[:, span - SIDE : span + SIDE + 1])
        best = np.zeros(len(x))
        with np.errstate(invalid="ignore"):
            steps = np.abs(np.diff(wide, axis=1))  # column k: from offset k - span to the next
            for length in range(1, SPIKE + 1):
                for o in range(length):
                    a, b = span - o, span - o + length  # columns of the run are a up to b
                    run = wide[:, a:b]
                    before, after = wide[:, a - SIDE : a], wide[:, b : b + SIDE]
                    around = np.stack([_median(before), _median(after), before[:, -1], after[:, 0]], axis=1)
                    up = run.min(axis=1) - around.max(axis=1)
                    down = around.min(axis=1) - run.max(axis=1)
                    size = np.fmax(up, down)  # NaN where a side or the run is missing
                    calm = np.fmin(
                        np.nan_to_num(steps[:, a - 3 : a - 1]).max(axis=1), np.nan_to_num(steps[:, b : b + 2]).max(axis=1)
                    )
                    best = np.fmax(best, np.where(size > STEEP * calm, size, 0))
        jump[keep] = best
        odd = np.flatnonzero(~possible)
        place = np.searchsorted(keep, odd)
        for near in (np.minimum(place, len(keep) - 1), np.maximum(place - 1, 0)):  # the one before counts, if there is one
            same = group[keep[near]] == group[odd]
            level[odd[same]] = level[keep[near[same]]]
        with np.errstate(invalid="ignore"):
            jump[odd] = np.nan_to_num(np.abs(v[odd] - level[odd]), nan=0.0, posinf=np.inf)
    begins = np.ones(n, bool)
    begins[1:] = (v[1:] != v[:-1]) | (group[1:] != group[:-1])
    runs = np.cumsum(begins) - 1
    stuck = np.bincount(runs, minlength=1)[runs] >= STUCK if n else np.zeros(0, bool)
    return {"level": level, "jump": jump, "stuck": stuck}


def _walk(limits: dict[str, tuple[float, float]]):
    """A function over Arrow batches sorted by series, chunk and time. It holds one chunk beyond a batch at most."""

    def of(table: pa.Table) -> pa.RecordBatch:
        def edges(data: pa.Table) -> np.ndarray:
            codes = [data["_chunk"].to_numpy()]
            for k in ("_source", "_type"):
                codes.append(data[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False))
            edge = np.ones(len(data), bool)
            edge[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
            return edge

        ids, at, values = table["_id"].combine_chunks(), table["_at"].to_numpy(), table["_value"].to_numpy()
        fresh = edges(table)
        fresh[1:] |= (at[1:] != at[:-1]) | (values[1:] != values[:-1])
        fresh[1:] |= ~pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
        data = table if fresh.all() else table.filter(pa.array(fresh)).combine_chunks()  # repeated deliveries are neighbours
        group = np.cumsum(edges(data))
        v = data["_value"].to_numpy()
        kinds = data["_type"].combine_chunks().dictionary_encode()
        names = [*kinds.dictionary.to_pylist(), None]
        bounds = np.array([limits.get(x, (-np.finfo(float).max, np.finfo(float).max)) for x in names])
        index = kinds.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
        possible = (v >= bounds[index, 0]) & (v <= bounds[index, 1])
        got = features(group, v, possible)
        core = data["_core"].to_numpy()
        out = {
            "_id": data["_id"], "_source": data["_source"], "_type": data["_type"], "_context": data["_context"],
            "_value": pa.array(v), "_level": pa.array(got["level"], from_pandas=True), "_jump": pa.array(got["jump"]),
            "_possible": pa.array(possible), "_stuck": pa.array(got["stuck"]),
        }
        return pa.table(out).filter(pa.array(core)).combine_chunks()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            last = [rest[k][-1].as_py() for k in ("_source", "_type", "_chunk")]
            first = [rest[k][0].as_py() for k in ("_source", "_type", "_chunk")]
            if first == last:
                continue
            low, high = 0, rest.num_rows  # the rows of the last chunk are a tail: find where it begins
            low = rest.num_rows - 1
            step = 1
            while low > 0 and [rest[k][max(low - step, 0)].as_py() for k in ("_source", "_type", "_chunk")] == last:
                low = max(low - step, 0)
                step *= 2
            high, low = low, max(low - step, 0)
            while high - low > 1:
                mid = (low + high) // 2
                if [rest[k][mid].as_py() for k in ("_source", "_type", "_chunk")] == last:
                    high = mid
                else:
                    low = mid
            yield from of(rest.slice(0, high).combine_chunks()).to_batches()
            rest = rest.slice(high)
        if rest is not None:
            yield from of(rest.combine_chunks()).to_batches()

    return walk


def judged(
    df: DataFrame,
    id_col: str,
    source: str,
    type_col: str,
    at: str,
    value: str,
    limits: dict[str, tuple[float, float]] | None = None,
    fence: float = FENCE,
    screened: bool = False,
) -> DataFrame:
    """Every reading with its flags and a ``verdict``: impossible, spike, stuck or credible. Columns: id, source, type, value,
    ``beyond_limit``, ``outside_fence``, ``steep``, ``flat`` and verdict.

    ``at`` is in integer seconds. The same id, time and value again is the same reading. Null and NaN values and null times
    are no readings and are left out; infinite values are beyond any limit. ``limits`` gives (lowest, highest) possible
    values by type; types that it lacks have none. A null source or type makes a series of its own. Ties of time are
    ordered by id. Extra columns are ignored; an empty table gives an empty result.

    Method: readings of a source and type in order of time give the level (median of nine) and the residual to it, and
    for every run of at most three readings the jump by which it leaves the readings before and comes back to those
    after. Quantile sketches of the residuals are built on each partition by source, type and hour of the day and merged;
    hours with few readings use the sketches merged over six hours, or over all. ``outside_fence``: the residual lies
    ``fence`` interquartile ranges beyond the quartiles. ``steep``: the jump exceeds as much and is more than three times the
    steps on its calmer side, an implausible rate of change; climbs and falls come in steps of like size, lasting changes
    don't return. ``flat``: one of ten or more equal readings, without variance. A spike is outside and steep at once, as a
    climb is only outside; impossible and stuck readings take no part in the sketches. With ``screened``, readings that
    don't jump at all aren't held against fences too many to be sent to all tasks, which leaves the verdicts as they are.

    Long series are cut into chunks with neighbouring rows (see ``chunked``), so no task holds an unbounded series. The
    table is scanned for the sizes of series (three columns) and for the readings, which are shuffled once.
    """
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.col(source).alias("_source"),
        F.col(type_col).alias("_type"),
        F.col(at).cast("bigint").alias("_at"),
        F.col(value).cast("double").alias("_value"),
    ).where("_at is not null and _value is not null and not isnan(_value)")
    rows = chunked(rows, ["_source", "_type"], "_at", HALO)
    rows = rows.withColumn("_context", F.floor(F.pmod(F.col("_at"), F.lit(86400)) / F.lit(3600)).cast("int"))
    ordered = rows.repartition("_source", "_type", "_chunk").sortWithinPartitions("_source", "_type", "_chunk", "_at", "_id", "_value")
    schema = (
        "_id string, _source string, _type string, _context int, _value double, _level double, _jump double, "
        "_possible boolean, _stuck boolean"
    )
    seen = staged(ordered.mapInArrow(_walk(limits or {}), schema))

    residual = F.col("_value") - F.col("_level")
    normal = seen.where("_possible and not _stuck").withColumn("_residual", residual).where("_residual between -1e300 and 1e300")
    block = F.floor(F.col("_context") / F.lit(BLOCK_H)).alias("_block")
    series = ("_source", "_type")
    parts = normal.groupBy(*series, "_context").agg(F.kll_sketch_agg_double("_residual").alias("_sketch"))
    parts = staged(parts)  # three levels are made of them
    blocks = parts.groupBy(*series, block).agg(F.kll_merge_agg_double("_sketch").alias("_sketch"))
    whole = blocks.groupBy(*series).agg(F.kll_merge_agg_double("_sketch").alias("_sketch"))

    def quartiles(df: DataFrame, n: str, *keys: str) -> DataFrame:
        at_rank = [F.kll_sketch_get_quantile_double("_sketch", F.lit(r)).alias(f"_{n}{q}") for q, r in ((1, 0.25), (3, 0.75))]
        return df.select(*[F.col(k).alias(f"_{n}{k}") for k in keys], *at_rank, F.kll_sketch_get_n_double("_sketch").alias(f"_{n}n"))

    def same(n: str) -> Column:
        return F.col("_h_source").eqNullSafe(F.col(f"_{n}_source")) & F.col("_h_type").eqNullSafe(F.col(f"_{n}_type"))

    joined = quartiles(parts, "h", *series, "_context").join(quartiles(whole, "a", *series), same("a"))
    joined = joined.join(quartiles(blocks, "b", *series, "_block"), same("b") & (F.floor(F.col("_h_context") / F.lit(BLOCK_H)) == F.col("_b_block")))

    def chosen(q: int) -> Column:
        return F.when(F.col("_hn") >= FEW, F.col(f"_h{q}")).when(F.col("_bn") >= FEW, F.col(f"_b{q}")).otherwise(F.col(f"_a{q}"))

    fences = joined.select(
        F.col("_h_source").alias("_s"), F.col("_h_type").alias("_t"), F.col("_h_context").alias("_c"),
        chosen(1).alias("_low"), chosen(3).alias("_high"), (F.col("_a3") - F.col("_a1")).alias("_usual"),
    )

    names = [F.col("_id").alias(id_col), F.col("_source").alias(source), F.col("_type").alias(type_col), F.col("_value").alias(value)]
    on = F.col("_source").eqNullSafe(F.col("_s")) & F.col("_type").eqNullSafe(F.col("_t")) & (F.col("_context") == F.col("_c"))
    spread = F.greatest(F.col("_high") - F.col("_low"), F.col("_usual") * CALMEST, F.abs("_level") * LEAST)
    outside = F.coalesce((residual < F.col("_low") - fence * spread) | (residual > F.col("_high") + fence * spread), F.lit(False))
    steep = F.coalesce(F.col("_jump") > fence * spread, F.lit(False))
    no = F.lit(False)

    def told(df: DataFrame, outside: Column, steep: Column) -> DataFrame:
        verdict = F.when(~F.col("_possible"), "impossible").when(F.col("_stuck"), "stuck").when(outside & steep, "spike").otherwise("credible")
        flags = [(~F.col("_possible")).alias("beyond_limit"), outside.alias("outside_fence"), steep.alias("steep"), F.col("_stuck").alias("flat")]
        return df.select(*names, *flags, verdict.alias("verdict"))

    fences = staged(fences)  # a row per series and hour of day
    small = fences.count() <= SMALL_MAP
    if small:
        fences = F.broadcast(fences)
    if small or not screened:
        return told(seen.join(fences, on, "left"), outside, steep)
    jumpy = seen.where("_jump > 0").join(fences, on, "left")
    return told(seen.where("_jump <= 0"), no, no).unionByName(told(jumpy, outside, steep))
