"""Pieces of DuckDB SQL that the compared queries share."""

from __future__ import annotations

ORDER = "OVER (PARTITION BY symbol ORDER BY timestamp)"


def bars(hours: int, name: str = "bars") -> str:
    return f"""{name} AS (SELECT event_type AS symbol, '{hours}h' AS interval, time_bucket(INTERVAL '{hours} hours', ts, TIMESTAMP '1970-01-01') AS timestamp,
      arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(value) AS volume, count(*) AS trades
      FROM events GROUP BY ALL)"""


def rows(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) {rows(n)} = {n} THEN {fn}({x}) {rows(n)} END)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {ORDER}"


def index() -> str:
    return f"(row_number() {ORDER} - 1)"


def so_far(x: str) -> str:
    """All values up to the row as a list."""
    return f"list({x}) OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING)"


def ema(values: str, kind: str, span: float) -> str:
    """The exponential average of a list; "wilder" and "sma" give null before span values."""
    a = 1 / span if kind == "wilder" else 2 / (span + 1)
    q, n = 1 - a, f"len({values})"
    if kind == "weighted":
        return f"(list_sum(list_transform({values}, lambda v, k: v * pow({q!r}, {n} - k))) / list_sum(list_transform({values}, lambda v, k: pow({q!r}, {n} - k))))"
    if kind == "first":
        return f"(list_sum(list_transform({values}, lambda v, k: v * pow({q!r}, {n} - k) * CASE WHEN k = 1 THEN 1.0 ELSE {a!r} END)))"
    s = int(span)
    return f"(CASE WHEN {n} >= {s} THEN list_sum(list_transform({values}, lambda v, k: v * CASE WHEN k <= {s} THEN pow({q!r}, {n} - {s}) / {s} ELSE {a!r} * pow({q!r}, {n} - k) END)) END)"


def labels(source: str, raw: str, skip: int) -> str:
    """A label where raw differs from the last one, without the first `skip` of them: two CTEs after a source's, and the
    select."""
    before = "last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""lr AS (SELECT symbol, timestamp, {raw} AS raw FROM {source}),
      lk AS (SELECT *, CASE WHEN raw IS NOT NULL AND raw IS DISTINCT FROM {before} THEN raw END AS kept FROM lr)
      SELECT symbol, timestamp, CASE WHEN count(kept) {ORDER} > {skip} THEN kept END AS label FROM lk"""


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f'round({c}, {digits}) AS "{c}"' for c in columns)


def digamma(x: str) -> str:
    """psi(x): ten steps up, then the series."""
    y = f"(({x}) + 10)::DOUBLE"
    steps = " - ".join(f"1.0 / (({x}) + {i})" for i in range(10))
    return f"(ln({y}) - 0.5 / {y} - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) + 1 / (240 * pow({y}, 8)) - {steps})"
