"""The score ladder: one row per distinct score with running confusion counts.

Every ranking metric (AUC, average precision, curves, thresholds, quantiles) is
a fold over this one table. A plain ``Window.orderBy(score)`` would put a whole
score set into one task, and one condition or group may hold a third of all
rows, so the running sums are built bucket by bucket instead:

* rows are first counted per (keys, score), with map-side combine;
* a *part* holds the scores that agree in all but the lowest 26 bits, a *bucket*
  the parts that agree in all but the lowest 44 bits: 256 buckets per power of
  two and up to 262,144 parts in a bucket. A part has few rungs even where
  scores crowd together; single precision leaves it at most one;
* running sums are taken inside each part, then over the parts of a bucket, then
  over the buckets, and the offsets are handed down again. At the upper levels
  only one row per unit (its lowest rung) takes part in the window; the others
  are kept in lanes of their own, so no lane grows with the data.

The whole chain is one line of windows over one input: nothing is joined,
broadcast, sampled or collected, and a costly input is computed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.functions.numeric import nan_to_null, ordinal_sql

BUCKET_BITS = 44
PART_BITS = 26


def score_counts(df: DataFrame, keys: Sequence[str] = (), score: str = "s",
                 truth: str = "y") -> DataFrame:
    """Positives and negatives per distinct score; only labelled and scored rows count."""
    return (
        df.select(*keys, nan_to_null(F.col(score)).alias("score"),
                  F.col(truth).cast("int").alias("truth"))
        .where("score IS NOT NULL AND truth IS NOT NULL")
        .groupBy(*keys, "score")
        .agg(F.expr("count_if(truth = 1)").alias("pos"),
             F.expr("count_if(truth = 0)").alias("neg"))
    )


def _over(part: Sequence[str], order: str = "") -> str:
    """Running window text; without an order the whole partition."""
    by = f"PARTITION BY {', '.join(part)}" if part else ""
    return f"({by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" \
        if order else f"({by})"


def ladder_from_counts(counts: DataFrame, keys: Sequence[str] = (),
                       extra: Sequence[str] = (), below: bool = False) -> DataFrame:
    """Ladder over pre-counted ``(keys, score, pos, neg)`` rows.

    Adds ``tp``/``fp`` (rows with a score >= this one) and the class totals
    ``n_pos``/``n_neg``. ``extra`` columns ride along untouched. With ``below``
    a struct holds the counts of the next lower score, NULL at the lowest.
    """
    keys, extra = list(keys), list(extra)
    k = [f"`{c}`" for c in keys]
    keep = [*k, "score", *extra, "pos", "neg"]
    top = ["struct(pos, neg) AS top"] if below else []
    rows = counts.selectExpr(*keep, f"{ordinal_sql('score')} AS code").selectExpr(
        *keep, f"shiftright(code, {PART_BITS}) AS part",
        f"shiftright(code, {BUCKET_BITS}) AS bucket", *top)

    # up, inside a part: every rung takes part
    lanes = [*k, "part"]
    run, nxt = _over(lanes, "score DESC"), f"({_over(lanes, 'score DESC')[1:].split(' ROWS')[0]})"
    peek = [f"lead(top) OVER {nxt} AS below", f"first(top) OVER {run} AS top"] if below else []
    rows = rows.selectExpr(
        *keep, "part", "bucket", f"sum(pos) OVER {run} AS tp", f"sum(neg) OVER {run} AS fp",
        f"lead(score) OVER {nxt} IS NULL AS carry", *peek)

    # up, inside a bucket: only the lowest rung of each part carries its part's counts;
    # all others stay apart by part
    lane = "IF(carry, NULL, part)"
    rows = _climb(rows, [*k, "bucket", lane], "part", "part_tp", "part_fp",
                  [*keep, "part", "bucket", "tp", "fp", "carry"], below)

    # up, over the buckets: the lowest rung of each bucket carries
    lane = "IF(carry_on, NULL, part)"
    whole = _over([*k, lane])
    rows = _climb(rows, [*k, lane], "bucket", "bucket_tp", "bucket_fp",
                  [*keep, "part", "bucket", "tp", "fp", "carry", "carry_on",
                   "part_tp", "part_fp",
                   f"IF(carry_on, sum(IF(carry_on, own_tp, 0L)) OVER {whole}, NULL) AS n_pos",
                   f"IF(carry_on, sum(IF(carry_on, own_fp, 0L)) OVER {whole}, NULL) AS n_neg"],
                  below)

    # down: the bucket's offset and the totals reach the carriers, then everyone
    tail = ["below"] if below else []
    lane = _over([*k, "bucket", "IF(carry, NULL, part)"])
    rows = rows.selectExpr(
        *keep, "part", "tp", "fp", *tail,
        f"part_tp + max(bucket_tp) OVER {lane} AS part_tp",
        f"part_fp + max(bucket_fp) OVER {lane} AS part_fp",
        f"max(n_pos) OVER {lane} AS n_pos", f"max(n_neg) OVER {lane} AS n_neg")
    lane = _over(lanes)
    return rows.selectExpr(
        *keep, f"tp + max(part_tp) OVER {lane} AS tp", f"fp + max(part_fp) OVER {lane} AS fp",
        f"max(n_pos) OVER {lane} AS n_pos", f"max(n_neg) OVER {lane} AS n_neg", *tail)


def _climb(rows: DataFrame, lanes: Sequence[str], order: str, tp: str, fp: str,
           keep: Sequence[str], below: bool) -> DataFrame:
    """One level up: carriers of a lane sum what lies above them and elect the next carrier.

    A row's own sum is that of its unit so far (``own``); what the units above
    it hold is written to ``tp``/``fp``, NULL for rows that do not carry.
    """
    flag = "carry_on" if "carry_on" in rows.columns else "carry"
    own_tp, own_fp = ("own_tp", "own_fp") if flag == "carry_on" else ("tp", "fp")
    run = _over(lanes, f"{order} DESC")
    nxt = run.split(" ROWS")[0] + ")"
    out = [*keep,
           f"IF({flag}, sum({own_tp}) OVER {run} - {own_tp}, NULL) AS {tp}",
           f"IF({flag}, sum({own_fp}) OVER {run} - {own_fp}, NULL) AS {fp}"]
    if flag == "carry":
        out += [f"carry AND lead(score) OVER {nxt} IS NULL AS carry_on",
                f"sum(tp) OVER {run} AS own_tp", f"sum(fp) OVER {run} AS own_fp"]
    if below:
        out += [f"IF({flag}, coalesce(below, lead(top) OVER {nxt}), below) AS below",
                f"IF({flag}, first(top) OVER {run}, NULL) AS top"]
    return rows.selectExpr(*out)


def score_ladder(df: DataFrame, keys: Sequence[str] = (), score: str = "s",
                 truth: str = "y", below: bool = False) -> DataFrame:
    return ladder_from_counts(score_counts(df, keys, score, truth), keys, below=below)


def quantiles(df: DataFrame, qs: Sequence[float], keys: Sequence[str] = (),
              value: str = "s") -> DataFrame:
    """Exact quantiles with linear interpolation, one ``q<i>`` column per entry of ``qs``.

    ``percentile`` keeps a map of all distinct values of a group in one task;
    here the two neighbouring order statistics are picked off the ladder.
    """
    counts = (df.select(*keys, nan_to_null(F.col(value)).alias("score"))
              .where(F.col("score").isNotNull())
              .groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("pos"))
              .withColumn("neg", F.lit(0).cast("bigint")))
    lad = ladder_from_counts(counts, keys)
    return lad.groupBy(*keys).agg(*[
        quantile_of("pos", q).alias(f"q{i}") for i, q in enumerate(qs)])


def quantile_of(side: str, q: float):
    """Aggregate over ladder rows: the q-quantile of one class's scores."""
    n, upto = ("n_pos", "tp") if side == "pos" else ("n_neg", "fp")
    first = F.col(n) - F.col(upto)            # ascending 0-based rank of the row's first item
    last = first + F.col(side) - 1
    h = (F.col(n) - 1).cast("double") * F.lit(q)
    lo = F.floor(h)
    hi = F.least(lo + 1, F.col(n) - 1)
    at_lo = F.max(F.when((F.col(side) > 0) & (lo >= first) & (lo <= last), F.col("score")))
    at_hi = F.max(F.when((F.col(side) > 0) & (hi >= first) & (hi <= last), F.col("score")))
    t = F.max(h - lo.cast("double"))
    return F.when(t >= 0.5, at_hi - (at_hi - at_lo) * (1.0 - t)).otherwise(
        at_lo + (at_hi - at_lo) * t)
