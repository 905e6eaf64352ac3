"""Series of any length in two levels: time is cut into buckets, each is worked through alone, and what one leaves to the
next is carried over a table with one row a bucket. No task sorts or holds a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import KEYS, TIME
from barloom.functions.recursive import scan

#: Rows of a bucket, on average over the densest series.
ROWS = 100_000
BUCKET = "__bucket"


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def bucket_width(df: DataFrame, keys: Sequence[str] = KEYS, time: str = TIME, rows: int = ROWS) -> int:
    """Microseconds of a bucket that has `rows` rows of the densest series on average. One aggregation, one number."""
    n, span = F.count("*"), F.max(micros(time)) - F.min(micros(time)) + 1
    each = df.filter(F.col(time).isNotNull()).groupBy(*keys).agg((span * F.greatest(rows / n, F.lit(1e-6))).alias("w"))
    return max(1, int(each.agg(F.min("w")).first()[0] or 1))


def bucket_of(time: str, width: int) -> Column:
    return F.floor(micros(time) / F.lit(width))


def numbered(df: DataFrame, keys: Sequence[str] = KEYS, time: str = TIME, rows: int = ROWS, width: int | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """df with __bucket, __i (0, 1, ... in the series), __k (in the bucket) and, for each name of counts, how many rows of
    earlier buckets have a value there. df is shuffled once, by key and bucket; windows by both need no other shuffle."""
    width = width or bucket_width(df, keys, time, rows)
    d = df.withColumn(BUCKET, bucket_of(time, width))
    counts = counts or {}
    totals = d.groupBy(*keys, BUCKET).agg(F.count("*").alias("__n"), *[F.count(c).alias(n) for n, c in counts.items()])
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    offsets = totals.select(*keys, BUCKET, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in ("__n", *counts)])
    local = F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(time)) - 1
    return d.join(offsets, [*keys, BUCKET]).withColumn("__k", local).withColumn("__i", F.col("__n") + F.col("__k")).drop("__n")


def _carried(ends: DataFrame, keys: Sequence[str], decay: dict[str, float]) -> DataFrame:
    """(keys, __bucket, c_name): the filter's value before each bucket, from the buckets' own last values and rows."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ends.schema if f.name in (*keys, BUCKET)) + "".join(f", c_{n} double" for n in decay)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(BUCKET)
        out = part[[*keys, BUCKET]].copy()
        for name, q in decay.items():
            carry, values = 0.0, []
            for n, end in zip(part["__n"].tolist(), part[name].tolist()):
                values.append(carry)
                carry = carry * q**n + end
            out[f"c_{name}"] = values
        return out

    return ends.groupBy(*keys).applyInPandas(run, schema)


def recurrence(d: DataFrame, inputs: dict[str, tuple[Column, float]], keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """numbered() rows with a column for each name: y[t] = q * y[t-1] + u[t], over the whole series. Buckets are
    filtered alone; their last values are carried on, and each row adds its bucket's carry times a power of q."""
    local = scan(d, inputs, (*keys, BUCKET), time)
    at = F.col("__k")
    ends = local.groupBy(*keys, BUCKET).agg(F.count("*").alias("__n"), *[F.max_by(n, at).alias(n) for n in inputs])
    carry = _carried(ends, keys, {n: q for n, (_, q) in inputs.items()})
    out = local.join(carry, [*keys, BUCKET])
    return out.withColumns({n: F.col(n) + F.col(f"c_{n}") * F.pow(F.lit(q), at + 1) for n, (_, q) in inputs.items()}).drop(*[f"c_{n}" for n in inputs])


def ema_long(df: DataFrame, wanted: dict[str, tuple[str, str, float]], keys: Sequence[str] = KEYS, time: str = TIME, rows: int = ROWS, state: DataFrame | None = None) -> DataFrame:
    """df with the exponential averages of recursive.ema, kinds alike, for series of any length. With a state, what
    ema_state gave for earlier rows of the series, df are the rows after them: the same values as in one run over all."""
    return _averaged(df, wanted, keys, time, rows, state)[0].drop(BUCKET, "__i", "__k", "__state", *[f"__y_{n}" for n in wanted])


def ema_state(df: DataFrame, wanted: dict[str, tuple[str, str, float]], keys: Sequence[str] = KEYS, time: str = TIME, rows: int = ROWS, state: DataFrame | None = None) -> DataFrame:
    """(keys, n, y_name, seen_name, head_name): what the next rows of each series need. n rows so far; of each average the
    filter's last value, how many values there were, and the sum of the first span values. With a state it is carried
    on; series without new rows keep theirs. Stored after each append, it stands for the rows before."""
    d, _ = _averaged(df, wanted, keys, time, rows, state)
    s = lambda c: F.coalesce(F.first(F.col("__state")[c]), F.lit(0))
    at = F.col("__i")
    fields = [(s("n") + F.count("*")).alias("n")]
    for name, (_, x, span) in wanted.items():
        early = at + F.coalesce(F.col("__state.n"), F.lit(0)) < int(span)
        fields += [F.max_by(f"__y_{name}", at).alias(f"y_{name}"), (s(f"seen_{name}") + F.count(x)).alias(f"seen_{name}"), (s(f"head_{name}") + F.coalesce(F.sum(F.when(early, F.col(x))), F.lit(0.0))).alias(f"head_{name}")]
    new = d.groupBy(*keys).agg(*fields)
    return new if state is None else new.unionByName(state.join(new.select(*keys), list(keys), "left_anti"))


def _averaged(df: DataFrame, wanted: dict[str, tuple[str, str, float]], keys: Sequence[str], time: str, rows: int, state: DataFrame | None) -> tuple[DataFrame, dict]:
    """numbered() rows with the averages, and __y_name, each filter's own value."""
    seen = {f"__c{k}": F.col(x) for k, (kind, x, _) in enumerate(wanted.values()) if kind == "weighted"}
    d = numbered(df, keys, time, rows, counts=seen)
    if state is None:
        kept = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(f"{f}_{n}") for n in wanted for f in ("y", "seen", "head")])
        d = d.withColumn("__state", kept)
    else:
        d = d.join(state.select(*keys, F.struct("n", *[f"{f}_{n}" for n in wanted for f in ("y", "seen", "head")]).alias("__state")), list(keys), "left")
    past = lambda c: F.coalesce(F.col("__state")[c], F.lit(0))
    i = F.col("__i") + past("n")
    seeded = {f"__s{k}": (name, x, int(span)) for k, (name, (kind, x, span)) in enumerate(wanted.items()) if kind in ("sma", "wilder")}
    if seeded:  # means of the first rows: one row a series, from the few buckets that have them
        head = d.filter(i < max(span for _, _, span in seeded.values()))
        firsts = head.groupBy(*keys).agg(*[((F.coalesce(F.sum(F.when(i < span, F.col(x))), F.lit(0.0)) + F.coalesce(F.first(F.col("__state")[f"head_{name}"]), F.lit(0.0))) / span).alias(s) for s, (name, x, span) in seeded.items()])
        d = d.join(head.select(*keys, BUCKET).distinct().join(firsts, list(keys)), [*keys, BUCKET], "left")
    inputs = {}
    for k, (name, (kind, x, span)) in enumerate(wanted.items()):
        a, v = 1 / span if kind == "wilder" else 2 / (span + 1), F.col(x)
        if kind == "weighted":
            u = v
        elif kind == "first":
            u = F.when(i == 0, v).otherwise(v * a)
        else:
            u = F.when(i == int(span) - 1, F.col(f"__s{k}")).when(i >= int(span), v * a)
        inputs[f"__y_{name}"] = (u, 1 - a)
    out = recurrence(d, inputs, keys, time)
    out = out.withColumns({y: F.col(y) + past(y[2:]) * F.pow(F.lit(q), F.col("__i") + 1) for y, (_, q) in inputs.items()})
    made, so_far = {}, Window.partitionBy(*keys, BUCKET).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    for k, (name, (kind, x, span)) in enumerate(wanted.items()):
        y, q = F.col(f"__y_{name}"), inputs[f"__y_{name}"][1]
        if kind == "weighted":
            n = F.col(f"__c{k}") + F.count(x).over(so_far) + past(f"seen_{name}")
            made[name] = F.when(n > 0, y * (1 - q) / (1 - F.pow(F.lit(q), n)))
        else:
            made[name] = y if kind == "first" else F.when(i >= int(span) - 1, y)
    return out.withColumns(made).drop(*seen, *seeded), inputs


def last_value_before(events: DataFrame, edges: DataFrame, key: str, value: Column, order: Sequence[str], rows: int = ROWS) -> DataFrame:
    """edges (key, t, ...) with last: the value of the last event (key, t, ...) strictly before each edge, events of one
    time in the order of `order`; null where there is none.

    Within a bucket events and edges are sorted together; the last event of each bucket is carried over later ones."""
    width = bucket_width(events.unionByName(edges.select(key, "t"), allowMissingColumns=True), [key], "t", rows)
    e = events.withColumn(BUCKET, bucket_of("t", width)).select(key, BUCKET, "t", F.lit(1).alias("kind"), value.alias("x"), F.struct(*order).alias("tie"))
    tie = e.schema["tie"].dataType
    held = [c for c in edges.columns if c not in (key, "t")]
    b = edges.withColumn(BUCKET, bucket_of("t", width)).select(key, BUCKET, "t", F.lit(0).alias("kind"), F.lit(None).cast(e.schema["x"].dataType).alias("x"), F.lit(None).cast(tie).alias("tie"), *held)
    w = Window.partitionBy(key, BUCKET).orderBy("t", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    local = e.unionByName(b, allowMissingColumns=True).withColumn("last", F.last("x", ignorenulls=True).over(w)).filter("kind = 0")
    ends = e.groupBy(key, BUCKET).agg(F.max_by("x", F.struct("t", "tie")).alias("end")).unionByName(b.select(key, BUCKET).distinct().withColumn("end", F.lit(None).cast(e.schema["x"].dataType)))
    ends = ends.groupBy(key, BUCKET).agg(F.first("end", ignorenulls=True).alias("end"))
    before = Window.partitionBy(key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    carried = ends.select(key, BUCKET, F.last("end", ignorenulls=True).over(before).alias("carried"))
    return local.join(carried, [key, BUCKET]).select(key, "t", *held, F.coalesce("last", "carried").alias("last"))
