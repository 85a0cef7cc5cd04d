"""Sources mixed to target shares of the total size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

MOST_TARGETS = 10_000


def capped_mean(rate: float, cap: int) -> float:
    """Mean of a Poisson variable that is cut off at ``cap``."""
    p = below = math.exp(-rate)
    mean = 1.0 - below
    for j in range(1, cap):
        p *= rate / j
        below += p
        mean += max(0.0, 1.0 - below)
    return mean


def solved_rate(wanted: float, groups: list[tuple[float, int]]) -> float:
    """The Poisson rate at which texts of (tokens, cap) give ``wanted`` tokens in the mean; infinite if all copies are needed."""
    full = sum(t * c for t, c in groups)
    if wanted >= full * (1 - 1e-9):
        return math.inf
    low, high = 0.0, 1.0
    while high < 700 and sum(t * capped_mean(high, c) for t, c in groups) < wanted:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(t * capped_mean(mid, c) for t, c in groups) < wanted else (low, mid)
    return high if high < 700 else math.inf


def cumulative(rate: float, cap: int) -> list[float]:
    """The Poisson distribution function at 0 up to ``cap`` - 1."""
    if math.isinf(rate):
        return [0.0] * cap
    p = math.exp(-rate)
    out = [p]
    for j in range(1, cap):
        p *= rate / j
        out.append(min(1.0, out[-1] + p))
    return out


def planned(texts: DataFrame, targets: DataFrame, total: int | None) -> list[dict]:
    """For each source and cap: share, tokens, wanted tokens and Poisson rate. At most one row per target and cap comes to the driver."""
    sums = texts.groupBy("source", "cap").agg(F.sum("n_tokens").alias("tokens")).collect()
    shares = {r.source: r.target_share for r in targets.collect()}
    groups: dict[str, list[tuple[float, int]]] = {}
    for r in sums:
        groups.setdefault(r.source, []).append((float(r.tokens), r.cap))
    usable = {s: sum(t * c for t, c in g) for s, g in groups.items()}
    have = sum(shares[s] for s, full in usable.items() if full > 0 and shares[s] > 0)
    if not have:
        return []
    scaled = {s: shares[s] / have for s in groups}
    most = min(usable[s] / scaled[s] for s in groups if scaled[s] > 0 and usable[s] > 0)
    size = most if total is None else min(total, most)
    out = []
    for s, g in groups.items():
        rate = solved_rate(scaled[s] * size, g) if scaled[s] > 0 else 0.0
        out += [{"source": s, "cap": c, "tokens": int(t), "share": scaled[s], "wanted": scaled[s] * size, "rate": rate} for t, c in g]
    return out


def calibrated(drawn: DataFrame, plan: list[dict]) -> list[dict]:
    """The plan with rates at which the texts' own numbers come closest to the wanted tokens.

    The copies of all texts only grow with the rate, so one pass over the texts gives the tokens at several rates between a
    quarter and four times the solved one, and two more passes near the best of these. A source of few texts, whose numbers
    may all be high or low, thus comes within a text or so of its share.
    """
    spark = drawn.sparkSession
    rates = {p["source"]: p["rate"] for p in plan if 0 < p["rate"] < math.inf}
    wanted = {p["source"]: p["wanted"] for p in plan}
    near = [[2 ** (k / 4) for k in range(-8, 9)], [1 + 0.02 * k for k in range(-8, 9)], [1 + 0.0025 * k for k in range(-8, 9)]]
    for factors in near if rates else ():
        rows = [
            (p["source"], p["cap"], [cumulative(rates[p["source"]] * f, p["cap"]) for f in factors]) for p in plan if p["source"] in rates
        ]
        table = F.broadcast(spark.createDataFrame(rows, "source string, cap int, tries array<array<double>>"))
        sums = [
            F.sum(F.size(F.filter(F.col("tries")[i], lambda x: F.col("_u") >= x)) * F.col("n_tokens")).alias(f"s{i}") for i in range(len(factors))
        ]
        for r in drawn.join(table, ["source", "cap"]).groupBy("source").agg(*sums).collect():
            best = min(range(len(factors)), key=lambda i, r=r: (abs(r[f"s{i}"] - wanted[r.source]), abs(i - len(factors) // 2)))
            rates[r.source] *= factors[best]
    return [p | {"rate": rates.get(p["source"], p["rate"])} for p in plan]


def mixed(
    docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, doc_id: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """A training mix and the shares that it really reaches.

    ``docs``: ``doc_id``, ``source``, ``text_key`` (equal for equal texts) and ``n_tokens``; ``targets``: ``source``,
    ``target_share``, ``max_repeats``. The mix has a row per copy of a text (doc_id, source, copy, n_tokens, shuffle_key)
    in shuffled order; the report one per target (source, target_share, actual_share, n_texts, n_used, n_copies,
    most_copies, largest_text, n_tokens).

    Method: Poisson replication. The rate of a source is such that the mean of a Poisson variable cut off at
    ``max_repeats`` gives its share of the total; each text's number of copies is that distribution inverted at a
    uniform number that is hashed from seed and text, so it needs no state, is the same on every run, and a source of
    any size is spread as it lies. The rates are then adjusted to the numbers drawn (see ``calibrated``), as a small source
    would else miss its share by chance. Copies are exploded and sorted by a hash, a global shuffle. Without ``total`` the mix
    is the largest at which no source needs more than its repeats allow.

    Equal texts count as one, of the first document by id; if sources differ in their repeats, the least counts. Texts
    without tokens, null sources and sources without target are not used; a target without texts gets nothing, and the
    others keep their proportions. Nulls in share or repeats are 0. Shares need not add up to 1. Other columns are
    ignored; empty tables give an empty mix.
    """
    spark = docs.sparkSession
    goal = targets.where("source is not null").groupBy("source").agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.min("max_repeats"), F.lit(0)).cast("int").alias("max_repeats")
    )
    n = goal.count()
    if n > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    rows = docs.select(F.col(doc_id).alias("_id"), "source", "text_key", "n_tokens").where("n_tokens > 0")
    rows = rows.join(F.broadcast(goal), "source")
    texts = rows.groupBy("text_key").agg(F.min(F.struct("_id", "source", "n_tokens")).alias("_first"), F.min("max_repeats").alias("cap"))
    texts = texts.select("text_key", F.col("_first._id").alias("_id"), F.col("_first.source").alias("source"), F.col("_first.n_tokens").alias("n_tokens"), "cap")
    texts = staged(texts)

    mask = F.lit((1 << 53) - 1).cast("bigint")
    numbered = texts.withColumn("_u", F.xxhash64(F.lit(seed), "text_key").bitwiseAND(mask) / F.lit(float(1 << 53)))
    plan = calibrated(numbered, planned(texts, goal, total))
    steps = [(p["source"], p["cap"], cumulative(p["rate"], p["cap"])) for p in plan]
    table = F.broadcast(spark.createDataFrame(steps, "source string, cap int, steps array<double>"))
    drawn = numbered.join(table, ["source", "cap"])
    drawn = drawn.withColumn("_copies", F.size(F.filter("steps", lambda x: F.col("_u") >= x)))
    copies = drawn.where("_copies > 0").select("_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "_copies")).alias("copy"))
    key = F.xxhash64(F.lit(seed + 1), "_id", "copy").alias("shuffle_key")
    mix = copies.select(F.col("_id").alias(doc_id), "source", "copy", "n_tokens", key).orderBy("shuffle_key", doc_id, "copy")

    used = drawn.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("_copies") > 0).alias("n_used"), F.sum("_copies").alias("n_copies"),
        F.max("_copies").alias("most_copies"), F.max("n_tokens").alias("largest_text"), F.sum(F.col("_copies") * F.col("n_tokens")).alias("n_tokens"),
    )
    whole = used.agg(F.sum("n_tokens").alias("_all"))
    report = F.broadcast(goal).join(used, "source", "left").crossJoin(F.broadcast(whole))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_texts", "n_used", "n_copies", "most_copies", "largest_text", "n_tokens")]
    share = F.coalesce(F.try_divide(F.col("n_tokens"), F.col("_all")), F.lit(0.0)).alias("actual_share")
    return mix, report.select("source", "target_share", share, *zero)
