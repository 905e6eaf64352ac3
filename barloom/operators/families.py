"""Feature families. Each takes bars and gives them with its columns; the wide table is their composition.

Warm-up rules differ by family and are kept: Bollinger basis and bands, slopes and RSI are 0 in their warm-up,
market and horizon columns are null; the wide table fills nulls with 0 twice on the way, before the horizon family.
Divisions by 0 give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import add, div, lag, last_rows, lead, nonzero, pct_change, roll, rolling_corr, row_index, so_far, zero
from barloom.functions.recursive import ema
from barloom.operators.bars import direction


def slope_pct(x: str, k: int, floor: float = 0.0) -> Column:
    """Change over k rows in percent of the older value's size; 0 where that is at most floor, or missing."""
    old = lag(x, k)
    return zero(F.when(F.abs(old) > floor, (F.col(x) - old) / F.abs(old) * 100))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    tag = "long" if fast == 12 else "short"
    line, sig, hist = f"MACD_macd_line_{tag}", f"MACD_signal_line_{tag}", f"MACD_macd_histogram_{tag}"
    df = ema(df, {"__fast": ("weighted", "close", fast), "__slow": ("weighted", "close", slow)})
    df = ema(add(df, **{line: F.col("__fast") - F.col("__slow")}).drop("__fast", "__slow"), {sig: ("weighted", line, signal)})
    gap = F.col(line) - F.col(sig)
    df = add(df, **{hist: gap, f"MACD_trend_direction_{tag}": F.signum(gap).cast("int"), f"MACD_macd_distance_{tag}": div(gap, roll(F.avg, "close", slow)) * 100})
    return add(df, **{f"MACD_macd_slope_{tag}": slope_pct(line, 4, 1e-9), f"MACD_signal_slope_{tag}": slope_pct(sig, 4, 1e-9), f"MACD_histogram_slope_{tag}": slope_pct(hist, 4, 1e-9)})


def bollinger(df: DataFrame, n: int = 20, mult: float = 2.0) -> DataFrame:
    basis, up, low, sig = f"BB_basis_{n}", f"BB_upper_band_{n}", f"BB_lower_band_{n}", f"BB_bband_signal_{n}"
    mean, dev = roll(F.avg, "close", n), roll(F.stddev_samp, "close", n)
    df = add(df, **{basis: zero(mean), up: zero(mean + mult * dev), low: zero(mean - mult * dev), "__i": row_index()})
    c1, c2 = lag("close", 1), lag("close", 2)
    raw = F.when((F.col("__i") >= n + 1) & (c1 < lag(up, 1)) & (c2 >= lag(up, 2)), 1).when((F.col("__i") >= n + 1) & (c1 > lag(low, 1)) & (c2 <= lag(low, 2)), -1).otherwise(0)
    df = add(df, __raw=raw)
    first = (F.col("__raw") != 0) & (F.count_if(F.col("__raw") != 0).over(so_far()) == 1)
    width = F.col(up) - F.col(low)
    df = add(
        df,
        **{
            sig: F.when(first, 0).otherwise(F.col("__raw")),
            f"BB_band_width_{n}": zero(div(width, nonzero(F.col(basis))) * 100),
            f"BB_price_band_pos_{n}": zero(F.least(F.greatest(div(F.col("close") - F.col(low), width), F.lit(0.0)), F.lit(1.0))),
            f"BB_upper_dist_{n}": zero(div(F.col(up) - F.col("close"), "close") * 100),
            f"BB_lower_dist_{n}": zero(div(F.col("close") - F.col(low), "close") * 100),
            f"BB_basis_slope_{n}": slope_pct(basis, 2),
            f"BB_upper_slope_{n}": slope_pct(up, 2),
            f"BB_lower_slope_{n}": slope_pct(low, 2),
        },
    )
    return df.drop("__i", "__raw")


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's index; 0 for the first n rows, 100 where nothing fell."""
    change = F.col("close").cast("double") - lag("close")
    df = add(df, __g=F.greatest(change, F.lit(0.0)), __l=F.greatest(-change, F.lit(0.0)), __k=row_index())
    # the first change is at row 1: its series starts there
    df = add(df, __g1=lead("__g"), __l1=lead("__l"))
    df = add(df, __g1=zero(F.col("__g1")), __l1=zero(F.col("__l1")))
    df = ema(df, {"__ag": ("wilder", "__g1", n), "__al": ("wilder", "__l1", n)})
    df = add(df, __ag=lag("__ag"), __al=lag("__al"))
    value = F.when(F.col("__k") < n, 0.0).when(F.col("__al") == 0, 100.0).otherwise(100 - 100 / (1 + div("__ag", "__al")))
    df = add(df, **{f"RSI_{n}": value})
    x, k = F.col(f"RSI_{n}"), F.col("__k")
    df = add(
        df,
        **{
            f"RSI_signal_{n}": F.when((k >= 4) & (x < 30), -1).when((k >= 4) & (x > 70), 1).otherwise(0),
            f"RSI_distance_{n}": x - 50,
            f"RSI_slope_{n}": zero(x - lag(f"RSI_{n}", 10)),
            f"RSI_oversold_{n}": F.greatest(30 - x, F.lit(0.0)),
            f"RSI_overbought_{n}": F.greatest(x - 70, F.lit(0.0)),
        },
    )
    return df.drop("__g", "__l", "__g1", "__l1", "__ag", "__al", "__k")


def market(df: DataFrame, lags: tuple[int, ...] = (1,), volatility: tuple[int, ...] = (4, 8), volume: tuple[int, ...] = (4, 8)) -> DataFrame:
    m = "MARKET_FEATURES_"
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    df = add(df, **{f"{m}price_return": pct_change("close")})
    df = add(df, **{f"{m}price_velocity": F.col(f"{m}price_return") - lag(f"{m}price_return")})
    df = add(df, **{f"{m}price_acceleration": F.col(f"{m}price_velocity") - lag(f"{m}price_velocity")})
    out: dict[str, Column] = {}
    for k in lags:
        out |= {f"{m}{x}_lag_{k}": lag(f"{m}price_{x}", k) for x in ("return", "velocity", "acceleration")}
    out |= {f"{m}volatility_{n}": roll(F.stddev_samp, f"{m}price_return", n) for n in volatility}
    span = h - low + 1e-8
    out |= {
        f"{m}candle_body_ratio": (c - o) / span,
        f"{m}upper_shadow_ratio": (h - F.greatest(o, c)) / span,
        f"{m}lower_shadow_ratio": (F.least(o, c) - low) / span,
        f"{m}close_position_ratio": (c - low) / span,
        f"{m}open_position_ratio": (o - low) / span,
        f"{m}candle_direction": F.signum(c - o),
        f"{m}high_close_strength": (h - c) / span,
        f"{m}close_low_strength": (c - low) / span,
        f"{m}volume_force": v * F.signum(c - o),
        f"{m}money_flow": (2 * c - h - low) / span * v,
        f"{m}obv_change": zero(v * F.signum(c - lag("close"))),
        "__dv": pct_change("volume"),
    }
    df = add(df, **out)
    df = add(df, **{f"{m}obv": F.sum(f"{m}obv_change").over(so_far())})
    out = {}
    for n in volume:
        mean = nonzero(roll(F.avg, "volume", n))
        pos, neg = roll(F.sum, F.greatest(F.col(f"{m}money_flow"), F.lit(0.0)), n), roll(F.sum, F.greatest(-F.col(f"{m}money_flow"), F.lit(0.0)), n)
        floor = lambda x: F.when(x == 0, 1e-8).otherwise(x)
        out |= {
            f"{m}rel_volume_{n}": div(v, mean),
            f"{m}volume_trend_{n}": pct_change("volume", n),
            f"{m}price_vol_corr_{n}": rolling_corr(F.col(f"{m}price_return"), F.col("__dv"), n),
            f"{m}norm_volume_force_{n}": div(f"{m}volume_force", mean),
            f"{m}money_flow_ratio_{n}": floor(pos) / floor(neg),
            f"{m}obv_slope_{n}": (F.col(f"{m}obv") - lag(f"{m}obv", n)) / n,
            f"{m}vol_adj_return_{n}": F.col(f"{m}price_return") * div(v, mean),
        }
    return add(df, **out).drop("__dv")


def horizon(df: DataFrame, periods: tuple[int, ...] = (1,), forecast: int = 1, volume: str | None = None) -> DataFrame:
    """Averages, bands, momentum and virtual candles for each period (at least 3 rows each); volume names the column
    of the volume features, none: they are left out. FUTURE_BIAS looks ahead: a target, not a feature."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    for raw in periods:
        p = max(3, raw)
        ma, band, mom, vc = (f"HORIZON_ALIGNED_{x}_{raw}_" for x in ("MA", "BAND", "MOM", "VC"))
        tr = F.greatest(h - low, F.abs(h - lag("close")), F.abs(low - lag("close")))
        move = c - lag("close", p)
        df = ema(df, {"__f": ("first", "close", max(5, p // 2)), "__s": ("first", "close", max(10, p)), "__e": ("first", "close", p)})
        df = add(df, **{f"{ma}MACD": F.col("__f") - F.col("__s"), "__sma": roll(F.avg, "close", p), "__tr": tr, "__move": move, "__i": row_index().cast("double")})
        df = ema(df, {f"{ma}SIGNAL": ("weighted", f"{ma}MACD", max(3, p // 3))})
        slow, fast = F.col("__sma"), roll(F.avg, "close", max(3, p // 2))
        w = last_rows(p)
        full = F.count("close").over(w) == p
        known = F.col("__move").isNotNull()
        up, down = (roll(F.sum, F.when(known, F.greatest(x, F.lit(0.0))), p) for x in (F.col("__move"), -F.col("__move")))
        out = {
            f"{ma}FUTURE_BIAS": (lead("close", forecast) / c - 1) * 100,
            f"{ma}TMA": roll(F.avg, "__sma", p),
            f"{ma}MA_BAND_POS": div(c - slow, nonzero(F.round(fast - slow, 12))),
            f"{ma}HIST": F.col(f"{ma}MACD") - F.col(f"{ma}SIGNAL"),
            f"{band}DONCH_UPPER": roll(F.max, "high", p),
            f"{band}DONCH_LOWER": roll(F.min, "low", p),
            f"{band}KELT_UPPER": F.col("__e") + 2 * roll(F.avg, "__tr", p),
            f"{band}KELT_LOWER": F.col("__e") - 2 * roll(F.avg, "__tr", p),
            f"{band}KELT_MID": F.col("__e"),
            f"{mom}CMO": 100 * (up - down) / F.when(up + down == 0, 1.0).otherwise(up + down),
            f"{mom}COG": F.when(full, zero(div(sum((p - k) * lag("close", k) if k else p * c for k in range(p)), F.sum("close").over(w)))),
            f"{mom}MOM_STRENGTH": roll(F.sum, F.signum(c - o), p) / p,
            f"{vc}OPEN": lag("open", p - 1),
            f"{vc}HIGH": roll(F.max, "high", p),
            f"{vc}LOW": roll(F.min, "low", p),
            f"{vc}CLOSE": c,
        }
        if p <= 16:
            slope = F.when(full, F.regr_slope(c, F.col("__i")).over(w))
            out |= {f"{ma}LR_SLOPE": slope, f"{ma}LR_R2": F.when(full, F.when(F.max("close").over(w) == F.min("close").over(w), 0.0).otherwise(F.regr_r2(c, F.col("__i")).over(w))), f"{ma}LR_SLOPE_PCT": div(slope, slow) * 100}
        if p >= 7:
            bp = c - F.least(lag("low"), lag("close"))
            df = add(df, __bp=bp)
            part = lambda n: div(roll(F.sum, "__bp", n), roll(F.sum, "__tr", n))
            out[f"{mom}ULT_OSC"] = 100 * (4 * part(max(3, p // 4)) + 2 * part(max(5, p // 2)) + part(p)) / 7
        if volume:
            tp = (h + low + c) / 3
            df = add(df, __tp=tp)
            flow = F.col("__tp") * F.col(volume)
            df = add(df, __up=F.when(F.col("__tp") > lag("__tp"), flow).otherwise(0.0), __down=F.when(F.col("__tp") < lag("__tp"), flow).otherwise(0.0))
            lost = roll(F.sum, "__down", p)
            out |= {f"{ma}VOLUME_ROC": pct_change(volume, p) * 100, f"{mom}MFI": 100 - 100 / (1 + roll(F.sum, "__up", p) / F.when(lost == 0, 1e-10).otherwise(lost))}
        df = add(df, **out)
        donch, kelt = F.col(f"{band}DONCH_UPPER") - F.col(f"{band}DONCH_LOWER"), F.col(f"{band}KELT_UPPER") - F.col(f"{band}KELT_LOWER")
        size = F.col(f"{vc}HIGH") - F.col(f"{vc}LOW")
        body = F.abs(F.col(f"{vc}CLOSE") - F.col(f"{vc}OPEN"))
        df = add(
            df,
            **{
                f"{band}DONCH_MID": (F.col(f"{band}DONCH_UPPER") + F.col(f"{band}DONCH_LOWER")) / 2,
                f"{band}DONCH_POS": div(c - F.col(f"{band}DONCH_LOWER"), donch),
                f"{band}KELT_POS": div(c - F.col(f"{band}KELT_LOWER"), kelt),
                f"{band}CHAN_WIDTH_RATIO": div(donch, kelt),
                f"{vc}RANGE": size,
                f"{vc}BODY": body,
                f"{vc}DIRECTION": F.signum(F.col(f"{vc}CLOSE") - F.col(f"{vc}OPEN")),
                f"{vc}EFFICIENCY": div(body, size),
            },
        )
        d, b, r = f"{vc}DIRECTION", f"{vc}BODY", f"{vc}RANGE"
        vo, vcl, vh, vl = (F.col(f"{vc}{x}") for x in ("OPEN", "CLOSE", "HIGH", "LOW"))
        inside = lag(b, 1) < lag(b, 2)
        strong = (F.col(b) > 0.7 * F.col(r)) & (F.col(b) > 1.5 * lag(b))
        sign = lambda pos, neg: F.when(pos, 1).when(neg, -1).otherwise(0)
        df = add(
            df,
            **{
                f"{vc}THREE_INSIDE": sign((lag(d, 2) < 0) & inside & (F.col(d) > 0), (lag(d, 2) > 0) & inside & (F.col(d) < 0)),
                f"{vc}OUTSIDE": sign((lag(d) < 0) & (vo < lag(f"{vc}CLOSE")) & (vcl > lag(f"{vc}OPEN")), (lag(d) > 0) & (vo > lag(f"{vc}CLOSE")) & (vcl < lag(f"{vc}OPEN"))),
                f"{vc}GAP": sign(vl > lag(f"{vc}HIGH"), vh < lag(f"{vc}LOW")),
                f"{vc}THRUST": sign((F.col(d) > 0) & strong, (F.col(d) < 0) & strong),
            },
        )
        df = df.drop("__f", "__s", "__e", "__sma", "__tr", "__move", "__i", "__bp", "__tp", "__up", "__down")
    return df


def wide_features(df: DataFrame, volume: str | None = None) -> DataFrame:
    """All families over bars; nulls of the columns so far become 0 after Bollinger and after the market family."""
    df = df.select("symbol", "interval", "timestamp", "open", "high", "low", "close", "volume", direction().alias("direction"))
    df = macd(macd(df, 12, 26, 9), 8, 17, 9)
    df = bollinger(bollinger(df, 20), 50).fillna(0)
    df = market(rsi(df)).fillna(0)
    return horizon(df, volume=volume)
