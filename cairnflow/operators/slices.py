"""Batches cut to slices that encode to a bounded number of bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of a page and bytes of an encoded batch at most.
PAGE, MOST_BYTES = 5000, 8 << 20


def cuts(sizes: list[int], most: int) -> list[int]:
    """Where slices begin: a run of more than one element that encodes to more than ``most`` bytes is halved, again and
    again. An array of n elements takes their bytes, n - 1 commas and two brackets."""
    upto = [0]
    for s in sizes:
        upto.append(upto[-1] + s)
    out, open_ = [], [(0, len(sizes))]
    while open_:
        a, b = open_.pop()
        if b - a > 1 and upto[b] - upto[a] + (b - a - 1) + 2 > most:
            mid = a + (b - a) // 2
            open_ += [(mid, b), (a, mid)]
        elif b > a:
            out.append(a)
    return out


def sliced(pages: DataFrame, queue: str, page: str, order: str, size: str, most: int = MOST_BYTES) -> DataFrame:
    """The slices of every page: queue, page, ``slice`` (from 0), ``n``, ``bytes``, ``first``, ``last`` and ``anchor``.

    ``size`` is the bytes of an element's encoding. A page holds at most PAGE elements, as a page of the incremental scan
    does, so it is one task's work; only sizes are gathered, not elements. ``order`` is a bigint. One element is never
    split, whatever its size. The anchor, the last element of the page, is on the last slice alone: it may advance only
    when all slices are delivered. Null sizes count as 0; a null queue or page is one of its own.
    """
    rows = pages.select(F.col(queue).alias("_queue"), F.col(page).cast("bigint").alias("_page"), F.col(order).cast("bigint").alias("_order"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_size"))
    listed = rows.groupBy("_queue", "_page").agg(F.array_sort(F.collect_list(F.struct("_order", "_size"))).alias("_all"))

    def walk(batches):
        for batch in batches:
            out: list[tuple] = []
            for q, p, held in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                sizes = [x["_size"] for x in held]
                begins = cuts(sizes, most)
                for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(held)], strict=True)):
                    last = held[b - 1]["_order"]
                    out.append((q, p, k, b - a, sum(sizes[a:b]) + b - a + 1, held[a]["_order"], last, last if b == len(held) else None))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_q", "_p", "slice", "n", "bytes", "first", "last", "anchor"])

    kind = dict(rows.dtypes)["_queue"]
    done = listed.mapInArrow(walk, f"_q {kind}, _p bigint, slice bigint, n bigint, bytes bigint, first bigint, last bigint, anchor bigint")
    return done.withColumnsRenamed({"_q": queue, "_p": page})
