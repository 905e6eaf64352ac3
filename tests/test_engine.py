import json
import math
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.recursive import ema
from barloom.operators import align, backtest, families, geometry, splits, stats
from barloom.plans import registry
from barloom.sources import candles
from barloom.streaming.trends import Averages

START = datetime(2024, 1, 1)


def series(spark, closes, symbol="a", volume=None, spread=1.0):
    rows = []
    for i, c in enumerate(closes):
        o = closes[i - 1] if i else c
        v = 10.0 + i % 5 if volume is None else volume
        rows.append((symbol, "1h", START + timedelta(hours=i), float(o), float(max(o, c) + spread), float(min(o, c) - spread), float(c), float(v)))
    return spark.createDataFrame(rows, "symbol string, interval string, timestamp timestamp, open double, high double, low double, close double, volume double")


def values(df, column):
    return [r[0] for r in df.orderBy("symbol", "timestamp").select(column).collect()]


@pytest.fixture(scope="module")
def walk():
    return np.round(100 + np.cumsum(np.random.default_rng(1).normal(0, 1, 1300)), 2)


def test_averages_match_pandas_over_several_blocks(spark, walk):
    kinds = {"w": ("weighted", "close", 200), "f": ("first", "close", 26), "s": ("sma", "close", 18), "r": ("wilder", "close", 14)}
    out = ema(series(spark, walk), kinds)
    x = pd.Series(walk)
    assert np.allclose(values(out, "w"), x.ewm(span=200).mean(), rtol=1e-12)
    assert np.allclose(values(out, "f"), x.ewm(span=26, adjust=False).mean(), rtol=1e-12)
    for name, n, a in (("s", 18, 2 / 19), ("r", 14, 1 / 14)):
        want = [None] * (n - 1) + [x[:n].mean()]
        for v in x[n:]:
            want.append(want[-1] * (1 - a) + v * a)
        got = values(out, name)
        assert got[: n - 1] == [None] * (n - 1) and np.allclose(got[n - 1 :], want[n - 1 :], rtol=1e-12)


def test_weighted_average_skips_leading_nulls(spark, walk):
    df = series(spark, walk[:30]).withColumn("x", F.when(F.col("timestamp") >= START + timedelta(hours=5), F.col("close")))
    got = values(ema(df, {"e": ("weighted", "x", 9)}), "e")
    assert got[:5] == [None] * 5
    assert np.allclose(got[5:], pd.Series(walk[5:30]).ewm(span=9).mean())


def test_rsi_bounds_and_rising_series(spark, walk):
    got = values(families.rsi(series(spark, walk[:100])), "RSI_14")
    assert got[:14] == [0.0] * 14 and all(0 <= v <= 100 for v in got)
    assert values(families.rsi(series(spark, range(1, 30))), "RSI_14")[14:] == [100.0] * 15
    signal = values(families.rsi(series(spark, range(1, 30))), "RSI_signal_14")
    assert signal[:4] == [0] * 4 and signal[4:14] == [-1] * 10  # the zeros of the warm-up count as oversold


def test_bands_are_ordered_and_constant_prices_do_not_fail(spark, walk):
    rows = families.bollinger(series(spark, walk[:80])).select("BB_lower_band_20", "BB_basis_20", "BB_upper_band_20", "BB_price_band_pos_20").collect()
    assert all(a <= b <= c and 0 <= d <= 1 for a, b, c, d in rows)
    flat = families.wide_features(series(spark, [5.0] * 70, volume=0.0, spread=0.0), volume="volume")
    assert flat.count() == 70


def test_wide_table_has_all_columns(spark, walk):
    assert len(families.wide_features(series(spark, walk[:60])).columns) == 118 + 2  # symbol and interval are extra
    assert len(families.wide_features(series(spark, walk[:60]), volume="volume").columns) == 120 + 2


def test_features_do_not_look_ahead(spark, walk):
    full, part = (families.wide_features(series(spark, walk[:n])).drop("HORIZON_ALIGNED_MA_1_FUTURE_BIAS").orderBy("timestamp").toPandas() for n in (80, 60))
    pd.testing.assert_frame_equal(full.head(60), part)


def test_train_parameters_ignore_test_rows(spark, walk):
    a, b = walk[:100].copy(), walk[:100].copy()
    b[90:] = 1e6
    fits = [splits.fit_zscore(splits.chronological(series(spark, x)), ["close"]).collect() for x in (a, b)]
    assert fits[0] == fits[1]
    df = splits.chronological(series(spark, a))
    p = splits.fit_zscore(df, ["close"])
    back = splits.undo_zscore(splits.apply_zscore(df, p, ["close"]).drop("close"), p, ["close"])
    assert np.allclose(values(back, "close"), a)


def test_splits_and_sequences(spark, walk):
    names = values(splits.chronological(series(spark, walk[:20])), "split")
    assert names == ["train"] * 14 + ["val"] * 3 + ["test"] * 3
    assert values(splits.fixed(series(spark, walk[:10]), 4, 3), "split") == ["train"] * 3 + ["val"] * 3 + ["test"] * 4
    seq = splits.sequences(series(spark, walk[:10]), ["close"], "volume", 4)
    assert seq.count() == 6 and all(len(r.x) == 4 for r in seq.collect())


def test_tolerance_and_asof_joins(spark):
    a = series(spark, [1, 2, 3, 4])
    b = a.select("symbol", (F.col("timestamp") + F.expr("INTERVAL 59 SECONDS")).alias("timestamp"), "close")
    assert align.tolerance_join(a, b, 60).count() == 4
    assert align.tolerance_join(a, b, 30).count() == 0
    t = spark.createDataFrame([("a", START, 1, 5.0), ("a", START + timedelta(seconds=9), 2, 6.0)], "symbol string, ts timestamp_ntz, event_id long, price double")
    edges = spark.createDataFrame([("a", START), ("a", START + timedelta(seconds=9)), ("a", START + timedelta(seconds=10))], "symbol string, boundary timestamp_ntz")
    assert [r.price for r in align.last_before(t, edges).orderBy("boundary").collect()] == [None, 5.0, 6.0]


def test_store_merges(spark):
    old, new = series(spark, range(10)), series(spark, range(15))
    assert align.append_newer(old, new).count() == 15
    assert align.prepend_older(new.filter(F.col("close") >= 5), new).count() == 15
    assert align.append_newer(old.limit(0), new).count() == 15


def test_pruning_and_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    rows = [(float(a), float(a * 2 + b / 100), float(c), 1.0) for a, b, c in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    assert stats.prune_correlated(df, ["a", "b", "c"]) == ["a", "c"]
    assert stats.prune_constant(df, ["a", "k"]) == ["a"]
    assert {r.corr for r in stats.correlations(df, ["a", "k"]).collect()} == {None}
    table = stats.variance_table(stats.fit_pca(df, ["a", "b", "c"], 3))
    z = (np.array(rows)[:, :3] - np.mean(np.array(rows)[:, :3], 0)) / np.std(np.array(rows)[:, :3], 0, ddof=1)
    eig = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert np.allclose([r["share"] for r in table], eig / eig.sum(), atol=1e-8)
    assert stats.component_counts(table)["kaiser"] == int((eig > 1).sum())
    assert stats.mutual_information(df.withColumn("y", (F.col("a") > 0).cast("int")), ["a", "c"], "y").orderBy(F.desc("mi")).first().feature == "a"


def test_backtest_by_hand(spark):
    df = series(spark, [10, 11, 12, 6]).withColumn("f", F.lit(1.0))
    out = backtest.portfolio(df, "f", start=1)
    assert np.allclose(values(out, "portfolio"), [1, 1.1, 1.2, 0.6])
    s = backtest.summary(out).first()
    assert s.trades == 3 and math.isclose(s.total_return, -0.4) and math.isclose(s.win_rate, 2 / 3)


def test_labels_alternate(spark, walk):
    for df in (backtest.live_bollinger(series(spark, walk[:300])), backtest.live_macd(series(spark, walk[:300])), backtest.live_rsi(families.rsi(series(spark, walk[:300])))):
        got = [x for x in values(df, "label") if x]
        assert all(a != b for a, b in zip(got, got[1:]))


def test_live_macd_starts_with_plain_means(spark, walk):
    x, fast, slow, sig = walk[:120], 18, 30, 18

    def seeded(v, n):
        out = [None] * (n - 1) + [float(np.mean(v[:n]))]
        for y in v[n:]:
            out.append(out[-1] + (y - out[-1]) * 2 / (n + 1))
        return out

    line = [None if b is None else a - b for a, b in zip(seeded(x, fast), seeded(x, slow))]
    signal = [None] * (slow - 1) + seeded(line[slow - 1 :], sig)
    signs = [None if s is None or i < slow + sig - 2 or a == s else ("MacdLE" if a > s else "MacdSE") for i, (a, s) in enumerate(zip(line, signal))]
    want, last = [None], None
    for s in signs[:-1]:
        want.append(s if s and s != last else None)
        last = s or last
    assert values(backtest.live_macd(series(spark, x)), "label") == want


def test_lines_cross_no_body(spark, walk):
    w = geometry.windows(series(spark, walk[:60]), 20, 20)
    assert w.groupBy("window_id").count().filter("count <> 20").count() == 0
    bars = {(r.window_id, r.bar): r for r in w.collect()}
    for line in geometry.trend_lines(w, least=2).collect():
        for b in range(20):
            r = bars[line.window_id, b]
            y = line.y1 + (line.y2 - line.y1) / (line.x2 - line.x1) * (b - line.x1)
            assert not (min(r.open, r.close) <= y < max(r.open, r.close))
    best = geometry.best_lines(geometry.trend_lines(w, least=2))
    tick = 0.01
    for line in geometry.clear_offset(best, w, tick).collect():
        sign = 1 if line.trend == "UP" else -1
        for k in range(1, line.offset + 1):
            free = True
            for b in range(20):
                r = bars[line.window_id, b]
                y = line.y1 + (line.y2 - line.y1) / (line.x2 - line.x1) * (b - line.x1) + sign * k * tick
                lo, hi = (min(r.open, r.close), max(r.open, r.close))
                free &= not ((lo <= y < hi) if sign > 0 else (lo < y <= hi))
            assert free == (k == line.offset)


def channels_of(bars, lines, tick):
    """The best channel of one window by loops: lines are (x1, y1, x2, y2, offset)."""
    up = sum(b.close - b.open for b in bars) > 0
    sign, rows = (1 if up else -1), []
    body = [(min(b.open, b.close), max(b.open, b.close)) for b in bars]
    wick = {True: [(b.low, lo) for b, (lo, hi) in zip(bars, body)], False: [(hi, b.high) for b, (lo, hi) in zip(bars, body)]}

    def count(y1, x1, slope, lower):
        return sum(a <= round(y1 + slope * (b - x1), 6) <= e for b, (a, e) in enumerate(wick[lower]))

    for x1, y1, x2, y2, offset in lines:
        slope, gap, places, t = (y2 - y1) / (x2 - x1), offset * tick, [], tick
        for k in range(6):
            t = tick + k * gap * 0.2
            if t < gap:
                places.append((count(y1 + sign * t, x1, slope, up), t))
        for score, shift in places:
            if score < max(places)[0]:
                continue
            far = [(count(y1 + sign * (shift + shift * m), x1, slope, not up), -m) for m in (1, 1.4, 1.8)]
            best, m = max(far)
            tips = [bars[x].low if up else bars[x].high for x in (x1, x2)]
            back = min(abs(y1 - max(tips)) + 0.05 * (max(b.high for b in bars) - min(b.low for b in bars)), shift)
            rows.append((-best, slope if slope > 0 else math.inf, x1, y1, x2, y2, shift, offset, shift - shift * m, back))
    return min(rows) if rows else None


def test_channels_match_loops(spark, walk):
    df, tick = series(spark, walk[:120]), 0.01
    w = geometry.windows(df, 20, 10)
    lines = geometry.clear_offset(geometry.trend_lines(w, grid=2, least=2), w, tick).cache()
    best = geometry.best_far_lines(geometry.far_lines(geometry.middle_lines(lines, w, tick), w))
    found = {r.window_id: r for r in geometry.channel_breakouts(best, df, tick, 20, 10, ahead=2).collect()}
    every, bars = df.orderBy("timestamp").collect(), {}
    for r in lines.collect():
        bars.setdefault(r.window_id, []).append((r.x1, r.y1, r.x2, r.y2, r.offset))
    assert len(found) > 3
    for k, own in bars.items():
        want = channels_of(every[10 * k : 10 * k + 20], own, tick)
        if want is None:
            assert k not in found
            continue
        r = found[k]
        _, _, x1, y1, x2, y2, shift, offset, far, back = want
        assert (r.x1, r.x2, r.offset, r.far_touches) == (x1, x2, offset, -want[0])
        assert np.allclose([r.y1, r.y2, r.shift, r.far_shift, r.back_shift], [y1, y2, shift, far, back])
        sign, out = (1 if r.trend == "UP" else -1), None
        for i in range(10 * k + 20, len(every)):
            y = y1 + (y2 - y1) / (x2 - x1) * (i - 10 * k - x1)
            near, clear, b = y - sign * back, y + sign * offset * tick, every[i]
            if (b.low < near or b.high > clear) if sign > 0 else (b.high > near or b.low < clear):
                out = i - 10 * k
                break
        assert r.breakout == out
    away = best.withColumn("offset", F.lit(10**5)).withColumn("back_shift", F.lit(1000.0))  # no bar leaves these
    assert geometry.channel_breakouts(away, df, tick, 20, 10).filter("breakout is not null").count() == 0
    late = best.withColumn("offset", F.lit(300)).withColumn("back_shift", F.lit(3.0))  # bars that leave later than the next two
    one, two = (sorted(map(tuple, geometry.channel_breakouts(late, df, tick, 20, 10, ahead=n).collect())) for n in (2, 200))
    assert one == two


def test_lines_moved_by_ticks_meet_prices_as_decimals_do(spark):
    """35 ticks of 0.01 are 0.35, as the SQL's decimals have it, and not 0.35000000000000003: 0.21 and these stay below
    0.56. Lines over bars without bodies stay, one tick from clear."""
    prices = "open double, high double, low double, close double"
    keys = "symbol string, interval string, window_id long, bar int"
    line = spark.createDataFrame([("a", "4h", 0, "UP", 0, 0.21, 2, 0.21, 3, 35)], "symbol string, interval string, window_id long, trend string, x1 int, y1 double, x2 int, y2 double, touches long, offset long")
    w = spark.createDataFrame([("a", "4h", 0, k, 0.3, 0.6, 0.2, 0.56) for k in range(3)], f"{keys}, {prices}")
    assert {(r.score, r.shift < 0.1) for r in geometry.middle_lines(line, w, 0.01).collect()} == {(0, True)}  # three wicks, three bodies
    bars = spark.createDataFrame([("a", "4h", k, 0.3, h, 0.3, 0.5) for k, h in enumerate((0.5, 0.5, 0.5, 0.55, 0.56, 0.6))], f"symbol string, interval string, timestamp int, {prices}")
    for ahead in (1, 50):
        assert [r.breakout for r in geometry.channel_breakouts(line.withColumn("back_shift", F.lit(0.1)), bars, 0.01, 3, 3, ahead).collect()] == [4]
    flat = spark.createDataFrame([("a", "4h", 0, k, 0.3, 0.6, 0.2, 0.3) for k in range(3)], f"{keys}, {prices}")
    assert [r.offset for r in geometry.clear_offset(line.drop("offset"), flat, 0.01).collect()] == [1]


def test_best_features_by_group(spark):
    scores = [("close", 1.0), ("open", 9.0), ("RSI_14", 8.0), ("RSI_a", 8.0), ("RSI_b", 2.0), ("MACD_x", 3.0), ("other", 7.0), ("HORIZON_z", 0.5)]
    got = stats.select_best(spark.createDataFrame(scores, "feature string, score double"), ["close"], 7, 2).orderBy("place").collect()
    assert [r.feature for r in got] == ["close", "RSI_14", "RSI_a", "MACD_x", "HORIZON_z", "open", "other"]
    few = stats.select_best(spark.createDataFrame(scores, "feature string, score double"), ["close"], 2, 2)
    assert few.count() == 5  # core and groups stay whole


def test_common_rows_take_the_first_frame(spark, walk):
    df = series(spark, walk[:6]).select("symbol", "interval", "timestamp", "close")
    a, b = df.filter(F.col("close") != walk[2]).withColumn("x", F.lit(1.0)), df.limit(5).withColumn("x", F.lit(2.0)).withColumn("z", F.lit(None).cast("double"))
    out = align.common_rows([a, b], ["x", "z"])
    assert out.columns == ["symbol", "interval", "timestamp", "x", "z"] and {(r.x, r.z) for r in out.collect()} == {(1.0, 0.0)}
    assert align.common_rows([a, b.limit(0)], ["x"]).count() == 0
    with pytest.raises(ValueError, match="no frame has"):
        align.common_rows([a, b], ["nothing"])


def test_csv_pages_and_times(spark, tmp_path):
    (tmp_path / "x.csv").write_text("time,open,high,low,close,volume,extra\n1704067200,1,2,0.5,1.5,10,7\n2024-01-01 01:00:00,1,2,x,1.5,10,7\n")
    rows = candles.read_csv(spark, str(tmp_path / "x.csv"), "s", "1h").orderBy("timestamp").collect()
    assert [r.timestamp for r in rows] == [START, START + timedelta(hours=1)] and rows[1].low is None and rows[0].extra == 7.0
    (tmp_path / "y.csv").write_text("time,open\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        candles.read_csv(spark, str(tmp_path / "y.csv"), "s", "1h")
    spark.dataSource.register(candles.KlinePages)
    page = [[i * 3_600_000, "1", "2", "0.5", "1.5", "9", i * 3_600_000 + 1, "1", 3, "0", "0", "0"] for i in range(3)]
    (tmp_path / "s-1h-0.json").write_text(json.dumps(page))
    got = spark.read.format("klines").options(path=str(tmp_path), symbol="s", interval="1h", start=0, end=6 * 3_600_000, limit=3).load()
    assert got.count() == 3 and got.rdd.getNumPartitions() == 2
    (tmp_path / "z.json").write_text(json.dumps({"columns": ["0", "1"], "index": [0], "data": [[1, "2.5"]]}))
    assert candles.read_split_json(spark, str(tmp_path / "z.json")).collect() == [("1", "2.5")]


def test_trend_state_uses_weighted_averages(walk):
    x = pd.Series(walk[:50])
    line = x.ewm(span=12).mean() - x.ewm(span=26).mean()
    found = [Averages.of(list(walk[: n + 1]), (12, 26, 9)).histogram() for n in range(50)]
    assert np.allclose(found, line - line.ewm(span=9).mean())


FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


@tables
def test_statistics_of_all_embedding_columns(spark):
    x = np.array(pd.read_parquet(f"{FOLDER}/embeddings.parquet")["embedding"].tolist(), float)
    want = np.corrcoef(x.T)
    got = {(r.f1, r.f2): r.corr for r in registry.queries()["corr_pairs_all"](spark, FOLDER).collect()}
    assert len(got) == 64 * 63 // 2 and all(abs(got[f"e{i}", f"e{j}"] - want[i, j]) < 1e-6 for i in range(64) for j in range(i + 1, 64))
    shares = [r.share for r in registry.queries()["pca_variance"](spark, FOLDER).orderBy("component").collect()]
    assert np.allclose(shares, np.sort(np.linalg.eigvalsh(want))[::-1] / 64, atol=1e-8)
    label = pd.read_parquet(f"{FOLDER}/embeddings.parquet")["label"].to_numpy()
    mi = {r.feature: r.mi for r in registry.queries()["mutual_information"](spark, FOLDER).collect()}
    for i in range(64):
        b = (x[:, i, None] > np.quantile(x[:, i], np.arange(1, 10) / 10)).sum(1)
        p = pd.crosstab(b, label).to_numpy() / len(x)
        own = p * np.log(np.where(p > 0, p / (p.sum(1, keepdims=True) * p.sum(0)), 1))
        assert abs(mi[f"e{i}"] - own.sum()) < 0.02
    assert len(mi) == 64


def lines_of(bars):
    """The lines of one window by brute force."""
    o, h, l, c = (np.array([r[k] for r in bars]) for k in ("open", "high", "low", "close"))
    up, lo, hi = sum(c - o) > 0, np.minimum(o, c), np.maximum(o, c)
    tip, edge = (l, lo) if up else (h, hi)
    points = [(b, y) for b in range(len(bars)) for y in sorted({tip[b] + (edge[b] - tip[b]) * k / 5 for k in range(6)})]
    out = {}
    for x1, y1 in points:
        for x2, y2 in points:
            slope = (y2 - y1) / (x2 - x1) if x1 < x2 else None
            if slope is None or (slope < 0 if up else slope > 0):
                continue
            y = y1 + slope * (np.arange(len(bars)) - x1)
            if (((lo <= y) & (y < hi)) | (y > h if up else y < l)).any():
                continue
            at, a, b = np.floor(y * 1e6 + 0.5), np.floor(np.minimum(tip, edge) * 1e6 + 0.5), np.floor(np.maximum(tip, edge) * 1e6 + 0.5)
            touches = int(((a <= at) & (at <= b)).sum())
            if touches >= 2:
                out[x1, round(y1, 6), x2, round(y2, 6)] = touches
    return out


@tables
def test_every_window_is_searched(spark):
    bars = registry.at(spark, FOLDER, 12).orderBy("timestamp").collect()
    series_of = {s: [b for b in bars if b.symbol == s] for s in {b.symbol for b in bars}}
    every = {(s, i) for s, b in series_of.items() for i in range(len(b) - 49)}
    assert len(every) > 5
    lines = {}
    for r in registry.queries()["trendlines_all"](spark, FOLDER).collect():
        lines.setdefault((r.symbol, r.window_id), {})[r.x1, r.y1, r.x2, r.y2] = r.touches
    want = {k: lines_of(series_of[k[0]][k[1] : k[1] + 50]) for k in every if k[0] == min(series_of)}
    assert {k: v for k, v in lines.items() if k[0] == min(series_of)} == {k: v for k, v in want.items() if v}
    for name in ("trend_all", "wick_overlap_all"):
        assert {(r.symbol, r.window_id) for r in registry.queries()[name](spark, FOLDER).collect()} == every
    for name in ("trendline_offsets", "trendline_breakouts"):
        assert {(r.symbol, r.window_id) for r in registry.queries()[name](spark, FOLDER).collect()} == set(lines)
