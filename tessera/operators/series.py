"""Financial-series indicators over (ticker, month) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans import Catalog, table
from tessera.plans.bind import PRICES, prices

catalog = Catalog()


def by():
    return Window.partitionBy("ticker").orderBy("month")


def last(n: int):
    return by().rowsBetween(-n + 1, 0)


def sma(value: str, n: int) -> Column:
    """Mean of the last n rows; null before there are n."""
    return F.when(F.count(value).over(last(n)) == n, F.avg(value).over(last(n)))


def crosses(p: DataFrame, short: int = 3, long: int = 12) -> DataFrame:
    """Golden and death crosses: the short mean moves above or below the long one."""
    x = p.select("ticker", "month", (sma("close", short) - sma("close", long)).alias("gap"))
    x = x.withColumn("before", F.lag("gap").over(by()))
    return x.select("ticker", "month", F.when((F.col("before") <= 0) & (F.col("gap") > 0), "golden").when((F.col("before") >= 0) & (F.col("gap") < 0), "death").alias("cross")).filter("cross IS NOT NULL")


_W = "WINDOW w AS (PARTITION BY ticker ORDER BY month)"
_sma = lambda n: f"CASE WHEN count(close) OVER (PARTITION BY ticker ORDER BY month ROWS {n - 1} PRECEDING) = {n} THEN avg(close) OVER (PARTITION BY ticker ORDER BY month ROWS {n - 1} PRECEDING) END"
catalog.add("sma_crosses", f"WITH {PRICES}, x AS (SELECT ticker, month, {_sma(3)} - {_sma(12)} AS gap FROM prices), y AS (SELECT *, lag(gap) OVER w AS before FROM x {_W}) SELECT ticker, month, CASE WHEN before <= 0 AND gap > 0 THEN 'golden' WHEN before >= 0 AND gap < 0 THEN 'death' END AS cross FROM y WHERE (before <= 0 AND gap > 0) OR (before >= 0 AND gap < 0)")(lambda s, d: crosses(prices(s, d)))


def emas(p: DataFrame, value: str, spans: tuple[int, ...]) -> DataFrame:
    """Exponential means of each ticker, the first value as the start."""
    rows = p.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("month", F.col(value).alias("v")))).alias("s"))
    start = F.struct(*[F.array().cast("array<double>").alias(f"e{n}") for n in spans])

    def step(acc: Column, x: Column) -> Column:
        nxt = lambda n: F.when(F.size(acc[f"e{n}"]) == 0, x["v"]).otherwise(F.element_at(acc[f"e{n}"], -1) + (x["v"] - F.element_at(acc[f"e{n}"], -1)) * (2.0 / (n + 1)))
        return F.struct(*[F.concat(acc[f"e{n}"], F.array(nxt(n))).alias(f"e{n}") for n in spans])

    done = rows.withColumn("e", F.aggregate("s", start, step))
    flat = done.select("ticker", F.explode(F.arrays_zip(F.col("s"), *[F.col(f"e.e{n}").alias(f"e{n}") for n in spans])).alias("z"))
    return flat.select("ticker", "z.s.month", *[F.col(f"z.e{n}").alias(f"e{n}") for n in spans])


@catalog.add("ema_macd")
def _macd(s, d):
    """EMA 20, MACD 12/26, its signal line of 9, and the crossings of the signal line and of zero."""
    e = emas(prices(s, d), "close", (12, 20, 26)).withColumn("m", F.col("e12") - F.col("e26"))
    x = e.join(emas(e, "m", (9,)), ["ticker", "month"]).withColumns({"gap": F.col("m") - F.col("e9")}).withColumns({"before": F.lag("gap").over(by()), "m0": F.lag("m").over(by())})
    cross = F.when((F.col("before") <= 0) & (F.col("gap") > 0), "bullish").when((F.col("before") >= 0) & (F.col("gap") < 0), "bearish")
    zero = F.when((F.col("m0") <= 0) & (F.col("m") > 0), "up").when((F.col("m0") >= 0) & (F.col("m") < 0), "down")
    return x.select("ticker", "month", F.round("e20", 6).alias("ema20"), F.round("m", 6).alias("macd"), F.round("e9", 6).alias("signal"), cross.alias("cross"), zero.alias("zero_cross"))


def rsi(p: DataFrame, n: int = 14) -> DataFrame:
    x = p.select("ticker", "month", (F.col("close") - F.lag("close").over(by())).alias("d"))
    gain, loss = F.sum(F.greatest("d", F.lit(0.0))).over(last(n)), F.sum(F.greatest(-F.col("d"), F.lit(0.0))).over(last(n))
    return x.select("ticker", "month", F.when(F.count("d").over(last(n)) == n, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))).alias("rsi")).filter("rsi IS NOT NULL")


_L = "OVER (PARTITION BY ticker ORDER BY month ROWS 13 PRECEDING)"
catalog.add("rsi", f"WITH {PRICES}, x AS (SELECT ticker, month, close - lag(close) OVER w AS d FROM prices {_W}), y AS (SELECT ticker, month, count(d) {_L} AS n, sum(greatest(d, 0)) {_L} AS g, sum(greatest(-d, 0)) {_L} AS l FROM x) SELECT ticker, month, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 4) AS rsi, CASE WHEN round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 4) > 70 THEN 'overbought' WHEN round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 4) < 30 THEN 'oversold' ELSE 'neutral' END AS level FROM y WHERE n = 14")(
    lambda s, d: rsi(prices(s, d)).select("ticker", "month", F.round("rsi", 4).alias("rsi")).withColumn("level", F.when(F.col("rsi") > 70, "overbought").when(F.col("rsi") < 30, "oversold").otherwise("neutral"))
)
catalog.add("stochastic", f"WITH {PRICES}, x AS (SELECT ticker, month, close, min(low) {_L} AS lo, max(high) {_L} AS hi, count(*) {_L} AS n FROM prices), y AS (SELECT ticker, month, 100 * (close - lo) / (hi - lo) AS k FROM x WHERE n = 14 AND hi > lo), z AS (SELECT ticker, month, k, CASE WHEN count(*) OVER v = 3 THEN avg(k) OVER v END AS d FROM y WINDOW v AS (PARTITION BY ticker ORDER BY month ROWS 2 PRECEDING)), u AS (SELECT *, lag(k - d) OVER w AS b FROM z {_W}) SELECT ticker, month, round(k, 4) AS k, round(d, 4) AS d, CASE WHEN round(k, 4) > 80 THEN 'overbought' WHEN round(k, 4) < 20 THEN 'oversold' ELSE 'neutral' END AS level, CASE WHEN b < -1e-9 AND k - d > 1e-9 THEN 'up' WHEN b > 1e-9 AND k - d < -1e-9 THEN 'down' END AS cross FROM u")(lambda s, d: stochastic(prices(s, d)))


def stochastic(p: DataFrame, n: int = 14, mean: int = 3) -> DataFrame:
    """%K, its mean %D, overbought above 80 and oversold below 20, and where %K crosses %D."""
    x = p.select("ticker", "month", "close", F.min("low").over(last(n)).alias("lo"), F.max("high").over(last(n)).alias("hi"), F.count("*").over(last(n)).alias("n")).filter((F.col("n") == n) & (F.col("hi") > F.col("lo")))
    x = x.select("ticker", "month", (100 * (F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("k"))
    x = x.withColumn("d", F.when(F.count("*").over(last(mean)) == mean, F.avg("k").over(last(mean)))).withColumn("gap", F.col("k") - F.col("d")).withColumn("b", F.lag("gap").over(by()))
    level = F.when(F.round("k", 4) > 80, "overbought").when(F.round("k", 4) < 20, "oversold").otherwise("neutral")
    cross = F.when((F.col("b") < -1e-9) & (F.col("gap") > 1e-9), "up").when((F.col("b") > 1e-9) & (F.col("gap") < -1e-9), "down")
    return x.select("ticker", "month", F.round("k", 4).alias("k"), F.round("d", 4).alias("d"), level.alias("level"), cross.alias("cross"))


catalog.add("obv_breakouts", f"WITH {PRICES}, x AS (SELECT *, lag(close) OVER w AS p, max(high) OVER (PARTITION BY ticker ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS prior, avg(volume) OVER (PARTITION BY ticker ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS mean FROM prices {_W}) SELECT ticker, month, round(sum(CASE WHEN close > p THEN volume WHEN close < p THEN -volume ELSE 0 END) OVER w, 2) AS obv, coalesce(close > prior, false) AS breakout, coalesce(volume > 2 * mean, false) AS spike FROM x {_W}")(
    lambda s, d: prices(s, d).withColumns({"p": F.lag("close").over(by()), "prior": F.max("high").over(by().rowsBetween(-12, -1)), "mean": F.avg("volume").over(by().rowsBetween(-12, -1))})
    .select("ticker", "month", F.round(F.sum(F.when(F.col("close") > F.col("p"), F.col("volume")).when(F.col("close") < F.col("p"), -F.col("volume")).otherwise(0.0)).over(by().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("obv"), F.coalesce(F.col("close") > F.col("prior"), F.lit(False)).alias("breakout"), F.coalesce(F.col("volume") > 2 * F.col("mean"), F.lit(False)).alias("spike"))
)
catalog.add("fibonacci_levels", f"WITH {PRICES} SELECT ticker, round(max(high) - 0.382 * (max(high) - min(low)), 4) AS l382, round(max(high) - 0.618 * (max(high) - min(low)), 4) AS l618 FROM prices GROUP BY ticker")(
    lambda s, d: prices(s, d).groupBy("ticker").agg(*[F.round(F.max("high") - x * (F.max("high") - F.min("low")), 4).alias(n) for n, x in (("l382", 0.382), ("l618", 0.618))])
)


def deciles(p: DataFrame) -> DataFrame:
    """Rows of each month by a z-score of close and volume, in tenths: the first short, the last long."""
    m = Window.partitionBy("month")
    z = lambda c: (F.col(c) - F.avg(c).over(m)) / F.nullif(F.stddev_samp(c).over(m), F.lit(0.0))
    x = p.select("ticker", "month", F.round(z("close") - z("volume"), 6).alias("score")).filter("score IS NOT NULL")
    x = x.withColumn("decile", F.ntile(10).over(m.orderBy("score", "ticker")))
    return x.withColumn("side", F.when(F.col("decile") == 10, "long").when(F.col("decile") == 1, "short").otherwise("none"))


catalog.add("factor_deciles", f"WITH {PRICES}, x AS (SELECT ticker, month, round((close - avg(close) OVER m) / nullif(stddev_samp(close) OVER m, 0) - (volume - avg(volume) OVER m) / nullif(stddev_samp(volume) OVER m, 0), 6) AS score FROM prices WINDOW m AS (PARTITION BY month)), y AS (SELECT *, ntile(10) OVER (PARTITION BY month ORDER BY score, ticker)::INT AS decile FROM x WHERE score IS NOT NULL) SELECT *, CASE decile WHEN 10 THEN 'long' WHEN 1 THEN 'short' ELSE 'none' END AS side FROM y")(lambda s, d: deciles(prices(s, d)))
catalog.add("pair_correlation", f"WITH {PRICES} SELECT a.ticker AS a, b.ticker AS b, round(corr(a.close, b.close), 6) AS corr, count(*) AS n FROM prices a JOIN prices b ON a.month = b.month AND a.ticker < b.ticker GROUP BY 1, 2")(
    lambda s, d: prices(s, d).alias("a").join(prices(s, d).alias("b"), (F.col("a.month") == F.col("b.month")) & (F.col("a.ticker") < F.col("b.ticker"))).groupBy(F.col("a.ticker").alias("a"), F.col("b.ticker").alias("b")).agg(F.round(F.corr("a.close", "b.close"), 6).alias("corr"), F.count("*").alias("n"))
)
_SPREAD = "OVER (PARTITION BY a, b ORDER BY month ROWS 13 PRECEDING)"
catalog.add("pair_spread", f"WITH {PRICES}, x AS (SELECT p.ticker AS a, q.ticker AS b, p.month, p.close - q.close AS spread FROM prices p JOIN prices q ON p.month = q.month AND p.ticker < q.ticker), y AS (SELECT *, avg(spread) {_SPREAD} AS m, stddev_samp(spread) {_SPREAD} AS sd, count(*) {_SPREAD} AS n FROM x), z AS (SELECT a, b, month, round((spread - m) / sd, 4) + 0 AS z FROM y WHERE n = 14 AND sd > 0) SELECT *, CASE WHEN z > 2 THEN 'short' WHEN z < -2 THEN 'long' WHEN abs(z) < 0.5 THEN 'exit' ELSE 'hold' END AS signal FROM z")(lambda s, d: pair_spread(prices(s, d)))


def pair_spread(p: DataFrame, n: int = 14, enter: float = 2.0, leave: float = 0.5) -> DataFrame:
    """(a, b, month, z, signal): z-score of each pair's spread over n months; beyond `enter` a trade against it, within `leave` its end."""
    x = p.alias("p").join(p.alias("q"), (F.col("p.month") == F.col("q.month")) & (F.col("p.ticker") < F.col("q.ticker"))).select(F.col("p.ticker").alias("a"), F.col("q.ticker").alias("b"), "p.month", (F.col("p.close") - F.col("q.close")).alias("spread"))
    w = Window.partitionBy("a", "b").orderBy("month").rowsBetween(1 - n, 0)
    y = x.withColumns({"m": F.avg("spread").over(w), "sd": F.stddev_samp("spread").over(w), "n": F.count("*").over(w)}).filter((F.col("n") == n) & (F.col("sd") > 0))
    y = y.select("a", "b", "month", (F.round((F.col("spread") - F.col("m")) / F.col("sd"), 4) + 0.0).alias("z"))
    return y.withColumn("signal", F.when(F.col("z") > enter, "short").when(F.col("z") < -enter, "long").when(F.abs("z") < leave, "exit").otherwise("hold"))


_R = f"r AS (SELECT ticker, month, close / lag(close) OVER w - 1 AS r FROM prices {_W}), v AS (SELECT ticker, month, stddev_samp(r) {_L} * sqrt(12) AS vol, count(r) {_L} AS n FROM r)"
catalog.add("volatility_target", f"WITH {PRICES}, {_R} SELECT ticker, month, round(vol, 6) AS vol, round(least(2.0, 0.1 / vol), 6) AS position FROM v WHERE n = 14 AND vol > 0")(
    lambda s, d: prices(s, d).select("ticker", "month", (F.col("close") / F.lag("close").over(by()) - 1).alias("r")).select("ticker", "month", (F.stddev_samp("r").over(last(14)) * F.sqrt(F.lit(12.0))).alias("vol"), F.count("r").over(last(14)).alias("n"))
    .filter("n = 14 AND vol > 0").select("ticker", "month", F.round("vol", 6).alias("vol"), F.round(F.least(F.lit(2.0), 0.1 / F.col("vol")), 6).alias("position"))
)
catalog.add("momentum_rank", f"WITH {PRICES}, x AS (SELECT ticker, month, lag(close, 1) OVER w / lag(close, 12) OVER w - 1 AS mom FROM prices {_W}) SELECT ticker, month, round(mom, 6) AS mom, round(percent_rank() OVER (PARTITION BY month ORDER BY mom), 6) AS rank FROM x WHERE mom IS NOT NULL")(
    lambda s, d: prices(s, d).select("ticker", "month", (F.lag("close", 1).over(by()) / F.lag("close", 12).over(by()) - 1).alias("m")).filter("m IS NOT NULL").select("ticker", "month", F.round("m", 6).alias("mom"), F.round(F.percent_rank().over(Window.partitionBy("month").orderBy("m")), 6).alias("rank"))
)
catalog.add("mean_reversion", f"WITH {PRICES}, x AS (SELECT ticker, month, close, avg(close) {_L} AS a, stddev_samp(close) {_L} AS sd, count(*) {_L} AS n FROM prices) SELECT ticker, month, round((close - a) / sd, 4) AS z, CASE WHEN close - a > sd THEN 'high' WHEN close - a < -sd THEN 'low' ELSE 'mid' END AS regime FROM x WHERE n = 14 AND sd > 0")(
    lambda s, d: prices(s, d).select("ticker", "month", "close", F.avg("close").over(last(14)).alias("a"), F.stddev_samp("close").over(last(14)).alias("sd"), F.count("*").over(last(14)).alias("n")).filter("n = 14 AND sd > 0").select("ticker", "month", F.round((F.col("close") - F.col("a")) / F.col("sd"), 4).alias("z"), F.when(F.col("close") - F.col("a") > F.col("sd"), "high").when(F.col("close") - F.col("a") < -F.col("sd"), "low").otherwise("mid").alias("regime"))
)
catalog.add("drawdown_sharpe", f"WITH {PRICES}, x AS (SELECT ticker, month, close, close / lag(close) OVER w - 1 AS r, max(close) OVER (PARTITION BY ticker ORDER BY month ROWS UNBOUNDED PRECEDING) AS peak FROM prices {_W}) SELECT ticker, round(min(close / peak - 1), 6) AS drawdown, round(avg(r) / stddev_samp(r) * sqrt(12), 6) AS sharpe, round(avg((r > 0)::INT), 6) AS win_rate FROM x GROUP BY ticker")(
    lambda s, d: prices(s, d).select("ticker", "close", (F.col("close") / F.lag("close").over(by()) - 1).alias("r"), F.max("close").over(by().rowsBetween(Window.unboundedPreceding, 0)).alias("peak")).groupBy("ticker").agg(F.round(F.min(F.col("close") / F.col("peak") - 1), 6).alias("drawdown"), F.round(F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(12.0)), 6).alias("sharpe"), F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("win_rate"))
)
catalog.add("ratio_screen", "WITH x AS (SELECT s_suppkey, s_nationkey, s_acctbal, sum(l_extendedprice) AS sales FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2, 3), m AS (SELECT s_nationkey, median(sales / s_acctbal) AS med FROM x WHERE s_acctbal > 0 GROUP BY 1) SELECT s_suppkey, round(sales / s_acctbal, 4) AS ratio FROM x JOIN m USING (s_nationkey) WHERE s_acctbal > 0 AND sales / s_acctbal < med")(
    lambda s, d: ratio_screen(table(s, d, "supplier").join(table(s, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_suppkey", "s_nationkey", "s_acctbal").agg(exact_sum("l_extendedprice").alias("sales")).filter("s_acctbal > 0"))
)


def exact_sum(c: str) -> Column:
    """Sum of doubles as decimals (to the tenth place), so equal rows have equal sums whatever their order, and none lies below a median of its like."""
    return F.sum(F.col(c).cast("decimal(38,10)")).cast("double")


def ratio_screen(x: DataFrame) -> DataFrame:
    """Rows whose ratio lies below their group's median."""
    x = x.withColumn("r", F.col("sales") / F.col("s_acctbal"))
    return x.join(x.groupBy("s_nationkey").agg(F.median("r").alias("med")), "s_nationkey").filter("r < med").select("s_suppkey", F.round("r", 4).alias("ratio"))


catalog.add("sentiment_ratio", "SELECT ts::DATE AS day, round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'error'), 0), 6) AS ratio, count(DISTINCT user_id) FILTER (event_type = 'purchase') >= 50 AS cluster FROM events GROUP BY 1")(
    lambda s, d: table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.count_if(F.col("event_type") == "purchase") / F.nullif(F.count_if(F.col("event_type") == "error"), F.lit(0)), 6).alias("ratio"), (F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))) >= 50).alias("cluster"))
)


def pick_outcomes(picks: DataFrame, p: DataFrame) -> DataFrame:
    """First month after a pick whose high reaches the target or low the stop; the stop first if both do."""
    j = picks.alias("k").join(p.alias("p"), (F.col("k.ticker") == F.col("p.ticker")) & (F.col("p.month") > F.col("k.month")))
    hit = F.when(F.col("p.low") <= F.col("stop"), "stop").when(F.col("p.high") >= F.col("target"), "target")
    out = j.select("k.ticker", "k.month", F.col("p.month").alias("hit_month"), hit.alias("hit")).filter("hit IS NOT NULL")
    return out.groupBy("ticker", "month").agg(F.min_by("hit", "hit_month").alias("hit"), F.min("hit_month").alias("hit_month"))


catalog.add("pick_outcomes", f"WITH {PRICES}, k AS (SELECT ticker, month, close * 1.9 AS target, close * 0.03 AS stop FROM prices), j AS (SELECT k.ticker, k.month, p.month AS hit_month, CASE WHEN low <= stop THEN 'stop' WHEN high >= target THEN 'target' END AS hit FROM k JOIN prices p ON k.ticker = p.ticker AND p.month > k.month) SELECT ticker, month, arg_min(hit, hit_month) AS hit, min(hit_month) AS hit_month FROM j WHERE hit IS NOT NULL GROUP BY 1, 2")(
    lambda s, d: pick_outcomes(prices(s, d).select("ticker", "month", (F.col("close") * 1.9).alias("target"), (F.col("close") * 0.03).alias("stop")), prices(s, d))
)


# Growth, extremes and returns.


def growth(p: DataFrame, value: str) -> DataFrame:
    """(ticker, month, mom, yoy, signal): growth on the row before and on the one a year before; 'accelerating' if the first is above the second's monthly share."""
    x = p.select("ticker", "month", (F.col(value) / F.nullif(F.lag(value, 1).over(by()), F.lit(0.0)) - 1).alias("mom"), (F.col(value) / F.nullif(F.lag(value, 12).over(by()), F.lit(0.0)) - 1).alias("yoy")).filter("mom IS NOT NULL AND yoy IS NOT NULL")
    x = x.select("ticker", "month", F.round("mom", 6).alias("mom"), F.round("yoy", 6).alias("yoy"))
    return x.withColumn("signal", F.when((F.col("yoy") > 0) & (F.col("mom") * 12 > F.col("yoy")), "accelerating").when(F.col("yoy") > 0, "growing").otherwise("shrinking"))


catalog.add("sales_growth", f"WITH {PRICES}, x AS (SELECT ticker, month, round(volume / nullif(lag(volume, 1) OVER w, 0) - 1, 6) AS mom, round(volume / nullif(lag(volume, 12) OVER w, 0) - 1, 6) AS yoy FROM prices {_W}) SELECT *, CASE WHEN yoy > 0 AND mom * 12 > yoy THEN 'accelerating' WHEN yoy > 0 THEN 'growing' ELSE 'shrinking' END AS signal FROM x WHERE mom IS NOT NULL AND yoy IS NOT NULL")(
    lambda s, d: growth(prices(s, d), "volume")
)


def leverage_screen(x: DataFrame, most: float = 2.0) -> DataFrame:
    """(id, leverage, margin, flag): debt by equity and margin of each row (id, debt, equity, revenue, cost); highly levered beyond `most`, thin below the median margin."""
    y = x.filter("equity > 0 AND revenue > 0").select("id", F.round(F.col("debt") / F.col("equity"), 6).alias("leverage"), F.round((F.col("revenue") - F.col("cost")) / F.col("revenue"), 6).alias("margin"))
    # A broadcast of one row.
    flag = F.when(F.col("leverage") > most, "levered").when(F.col("margin") < F.col("mid"), "thin").otherwise("sound")
    return y.join(F.broadcast(y.agg(F.median("margin").alias("mid")))).select("id", "leverage", "margin", flag.alias("flag"))


catalog.add("leverage_screen", """WITH x AS (SELECT o_custkey AS id, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS debt, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS equity, sum(o_totalprice) AS revenue, sum(o_totalprice) FILTER (o_orderstatus <> 'F') AS cost FROM orders GROUP BY 1),
y AS (SELECT id, round(debt / equity, 6) AS leverage, round((revenue - cost) / revenue, 6) AS margin FROM x WHERE equity > 0 AND revenue > 0) SELECT *, CASE WHEN leverage > 2 THEN 'levered' WHEN margin < (SELECT median(margin) FROM y) THEN 'thin' ELSE 'sound' END AS flag FROM y""")(
    lambda s, d: leverage_screen((lambda o: o.groupBy(F.col("o_custkey").alias("id")).agg(*[F.sum(F.when(c, F.col("o_totalprice"))).alias(n) for n, c in (("debt", F.col("o_orderstatus") == "O"), ("equity", F.col("o_orderstatus") == "F"), ("revenue", F.lit(True)), ("cost", F.col("o_orderstatus") != "F"))]))(table(s, d, "orders")))
)


def sentiment_extremes(days: DataFrame, high: float = 1.5) -> DataFrame:
    """(day, share, z, level): the bullish share of each day's bullish and bearish rows, its z-score in its month, and whether that is an extreme, which a contrarian reads the other way."""
    month = Window.partitionBy(F.trunc("day", "month"))
    x = days.filter("bull + bear > 0").withColumn("share", F.col("bull") / (F.col("bull") + F.col("bear")))
    z = (F.col("share") - F.avg("share").over(month)) / F.nullif(F.stddev_samp("share").over(month), F.lit(0.0))
    x = x.select("day", F.round("share", 6).alias("share"), (F.round(z, 4) + 0.0).alias("z"))
    return x.withColumn("level", F.when(F.col("z") > high, "greed").when(F.col("z") < -high, "fear").otherwise("neutral"))


catalog.add("sentiment_extremes", """WITH d AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS bull, count(*) FILTER (event_type = 'error') AS bear FROM events GROUP BY 1), x AS (SELECT day, bull / (bull + bear) AS share FROM d WHERE bull + bear > 0),
z AS (SELECT day, round(share, 6) AS share, round((share - avg(share) OVER m) / nullif(stddev_samp(share) OVER m, 0), 4) + 0 AS z FROM x WINDOW m AS (PARTITION BY date_trunc('month', day))) SELECT *, CASE WHEN z > 1.5 THEN 'greed' WHEN z < -1.5 THEN 'fear' ELSE 'neutral' END AS level FROM z""")(
    lambda s, d: sentiment_extremes(table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("bull"), F.count_if(F.col("event_type") == "error").alias("bear")))
)


def pick_returns(picks: DataFrame, p: DataFrame) -> DataFrame:
    """Per method: picks, those open (no hit), wins, the share of wins among closed picks and their mean return.

    picks: ticker, month, method, direction (long or short), entry, target, stop. A pick closes at its target or stop, whichever comes first; a short one gains by a fall.
    """
    long = F.col("k.direction") == "long"
    at_stop, at_target = F.when(long, F.col("p.low") <= F.col("k.stop")).otherwise(F.col("p.high") >= F.col("k.stop")), F.when(long, F.col("p.high") >= F.col("k.target")).otherwise(F.col("p.low") <= F.col("k.target"))
    hit = F.when(at_stop, "stop").when(at_target, "target")
    j = picks.alias("k").join(p.alias("p"), (F.col("k.ticker") == F.col("p.ticker")) & (F.col("p.month") > F.col("k.month"))).select("k.ticker", "k.month", "p.month", hit.alias("hit")).toDF("ticker", "month", "hit_month", "hit").filter("hit IS NOT NULL")
    first = j.groupBy("ticker", "month").agg(F.min_by("hit", "hit_month").alias("hit"))
    x = picks.join(first, ["ticker", "month"], "left").withColumn("out", F.when(F.col("hit") == "stop", F.col("stop")).when(F.col("hit") == "target", F.col("target")))
    x = x.withColumn("gain", F.when(F.col("direction") == "long", F.col("out") / F.col("entry") - 1).otherwise(1 - F.col("out") / F.col("entry")))
    return x.groupBy("method").agg(F.count("*").alias("picks"), F.count_if(F.col("hit").isNull()).alias("open"), F.count_if(F.col("hit") == "target").alias("wins"), F.round(F.count_if(F.col("hit") == "target") / F.nullif(F.count("hit"), F.lit(0)), 6).alias("win_rate"), F.round(F.avg("gain"), 6).alias("mean_return"))


catalog.add("pick_returns", f"""WITH {PRICES}, k AS (SELECT ticker, month, CASE WHEN volume % 3 < 1 THEN 'technical' WHEN volume % 3 < 2 THEN 'fundamental' ELSE 'sentiment' END AS method, CASE WHEN volume % 2 < 1 THEN 'long' ELSE 'short' END AS direction, close AS entry,
 CASE WHEN volume % 2 < 1 THEN close * 1.9 ELSE close * 0.05 END AS target, CASE WHEN volume % 2 < 1 THEN close * 0.03 ELSE close * 1.95 END AS stop FROM prices),
j AS (SELECT k.ticker, k.month, p.month AS hit_month, CASE WHEN direction = 'long' THEN CASE WHEN low <= stop THEN 'stop' WHEN high >= target THEN 'target' END ELSE CASE WHEN high >= stop THEN 'stop' WHEN low <= target THEN 'target' END END AS hit FROM k JOIN prices p ON k.ticker = p.ticker AND p.month > k.month),
f AS (SELECT ticker, month, arg_min(hit, hit_month) AS hit FROM j WHERE hit IS NOT NULL GROUP BY 1, 2), x AS (SELECT k.*, hit, CASE hit WHEN 'stop' THEN stop WHEN 'target' THEN target END AS o FROM k LEFT JOIN f ON k.ticker = f.ticker AND k.month = f.month)
SELECT method, count(*) AS picks, count(*) FILTER (hit IS NULL) AS open, count(*) FILTER (hit = 'target') AS wins, round(count(*) FILTER (hit = 'target') / nullif(count(hit), 0), 6) AS win_rate, round(avg(CASE WHEN direction = 'long' THEN o / entry - 1 ELSE 1 - o / entry END), 6) AS mean_return FROM x GROUP BY method""")(
    lambda s, d: pick_returns(
        prices(s, d).select(
            "ticker", "month", F.when(F.col("volume") % 3 < 1, "technical").when(F.col("volume") % 3 < 2, "fundamental").otherwise("sentiment").alias("method"), F.when(F.col("volume") % 2 < 1, "long").otherwise("short").alias("direction"), F.col("close").alias("entry"),
            F.when(F.col("volume") % 2 < 1, F.col("close") * 1.9).otherwise(F.col("close") * 0.05).alias("target"), F.when(F.col("volume") % 2 < 1, F.col("close") * 0.03).otherwise(F.col("close") * 1.95).alias("stop"),
        ),
        prices(s, d),
    )
)
