"""The registered queries in DuckDB SQL, written out as common table expressions."""

from __future__ import annotations

from ledgerline.operators import specs
from ledgerline.plans.queries import BRANDS_FROM, CAPITAL, CONFIDENCES, CORRECTED, CUSTOM, FAULTS, LATE_DAY, PATHS, RF, SPANS, STRAY_FILES, SUBSETS, TICKERS, WINDOW

TAIL = "0.050000000000000044::DOUBLE"
RATE = f"(pow(1 + {RF}::DOUBLE, 1 / 252::DOUBLE) - 1)"


def prices(column: str) -> str:
    return f"""SELECT p.{column} AS ticker, CAST(l.l_shipdate AS DATE) AS date, 100 * (1 + avg(l.l_discount)) AS close
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2"""


BENCHMARK = "SELECT 'ALL' AS ticker, CAST(l_shipdate AS DATE) AS date, 100 * (1 + avg(l_discount)) AS close FROM lineitem GROUP BY 2"


def returns_of(rel: str) -> str:
    return f"SELECT ticker, date, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM {rel}"


TYPE_RETURNS = f"""types AS ({prices("p_type")}), bench AS ({BENCHMARK}),
rets AS (SELECT r.ticker, r.date, r.ret, b.ret AS other FROM ({returns_of("types")}) r LEFT JOIN ({returns_of("bench")}) b USING (date))"""


def curve(rel: str, keys: str) -> str:
    return f"""SELECT *, round(curve / max(curve) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 12) AS drawdown FROM (
    SELECT *, product(1 + coalesce(ret, 0)) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) AS curve FROM {rel})"""


def rounds(columns: dict[str, int]) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c, d in columns.items())


def cleaning(rel: str, prefix: str) -> str:
    """CTEs prefix_filled, prefix_share, prefix_marked and prefix_clean of a relation ticker, date, close."""
    p = prefix
    return f"""
{p}_grid AS (SELECT d.date, t.ticker, s.close FROM (SELECT DISTINCT date FROM {rel}) d CROSS JOIN (SELECT DISTINCT ticker FROM {rel}) t LEFT JOIN {rel} s USING (date, ticker)),
{p}_filled AS (SELECT date, ticker, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close FROM {p}_grid),
{p}_share AS (SELECT ticker, avg(CASE WHEN close IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS missing_share FROM {p}_filled GROUP BY ticker),
{p}_marked AS (SELECT f.*, missing_share <= 0.10::DOUBLE AS kept FROM {p}_filled f JOIN {p}_share USING (ticker)),
{p}_complete AS (SELECT date FROM {p}_marked WHERE kept GROUP BY date HAVING count(close) = count(*)),
{p}_clean AS (SELECT ticker, date, close FROM {p}_marked JOIN {p}_complete USING (date) WHERE kept)"""


MEASURE_DIGITS = dict.fromkeys(
    "cagr volatility sharpe sortino max_drawdown calmar beta alpha tracking_error information_ratio var_95 cvar_95 correlation r_squared".split(), 8
)


def measures(rel: str, keys: str) -> str:
    """The fourteen measures of a relation keys, date, ret, other."""
    guard = "s_pair_other >= 1e-12"
    both = "s_own >= 1e-12 AND s_bench >= 1e-12"
    pair = "s_pair >= 1e-12 AND s_pair_other >= 1e-12"
    return f"""SELECT {keys}, cagr, CASE WHEN s_ret < 1e-12 THEN 0 ELSE s_ret * sqrt(252::DOUBLE) END AS volatility,
  CASE WHEN s_excess >= 1e-12 THEN m_excess * 252 / (s_excess * sqrt(252::DOUBLE)) END AS sharpe,
  CASE WHEN n_excess >= 2 AND down >= 1e-12 THEN m_excess * 252 / (down * sqrt(252::DOUBLE)) END AS sortino, max_drawdown,
  CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) END AS calmar,
  CASE WHEN {guard} THEN slope END AS beta, CASE WHEN {guard} THEN intercept * 252 END AS alpha,
  s_active * sqrt(252::DOUBLE) AS tracking_error, CASE WHEN s_active >= 1e-12 THEN m_active * 252 / (s_active * sqrt(252::DOUBLE)) END AS information_ratio,
  var_95, cvar_95, CASE WHEN {both} THEN c_own / (s_own * s_bench) END AS correlation,
  CASE WHEN {pair} THEN pow(c_pair / (s_pair * s_pair_other), 2) END AS r_squared
FROM (SELECT {keys},
    CASE WHEN product(1 + coalesce(ret, 0)) > 0 THEN pow(product(1 + coalesce(ret, 0)), 252::DOUBLE / count(*)) - 1 END AS cagr,
    stddev_samp(ret) AS s_ret, stddev_samp(ret - rf) AS s_excess, avg(ret - rf) AS m_excess, count(ret - rf) AS n_excess, sqrt(avg(pow(least(ret - rf, 0), 2)) FILTER (WHERE ret IS NOT NULL)) AS down,
    min(drawdown) AS max_drawdown, regr_slope(pair, pair_other) AS slope, regr_intercept(pair, pair_other) AS intercept, stddev_samp(pair_other) AS s_pair_other, stddev_samp(pair) AS s_pair,
    covar_samp(pair, pair_other) AS c_pair, stddev_samp(active) AS s_active, avg(active) AS m_active, stddev_samp(own) AS s_own, stddev_samp(bench) AS s_bench, covar_samp(own, bench) AS c_own,
    -max(tail) AS var_95, -avg(ret) FILTER (WHERE ret <= tail) AS cvar_95
  FROM (SELECT c.*, rf_ AS rf, q.tail,
          CASE WHEN ret IS NOT NULL AND other IS NOT NULL THEN ret - rf_ END AS pair, CASE WHEN ret IS NOT NULL AND other IS NOT NULL THEN other - rf_ END AS pair_other,
          ret - other AS active, CASE WHEN other IS NOT NULL THEN ret END AS own, CASE WHEN ret IS NOT NULL THEN other END AS bench
        FROM ({curve(rel, keys)}) c JOIN (SELECT {keys}, quantile_cont(ret, {TAIL}) AS tail FROM {rel} GROUP BY ALL) q USING ({keys}), (SELECT {RATE} AS rf_))
  GROUP BY {keys})"""


def cleaned_by_panel(rel: str, p: str) -> str:
    """As ``cleaning``, for a relation panel_id, ticker, date, close."""
    return f"""
{p}_grid AS (SELECT d.panel_id, d.date, t.ticker, s.close FROM (SELECT DISTINCT panel_id, date FROM {rel}) d JOIN (SELECT DISTINCT panel_id, ticker FROM {rel}) t USING (panel_id) LEFT JOIN {rel} s USING (panel_id, date, ticker)),
{p}_filled AS (SELECT panel_id, date, ticker, last_value(close IGNORE NULLS) OVER (PARTITION BY panel_id, ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close FROM {p}_grid),
{p}_share AS (SELECT panel_id, ticker, avg(CASE WHEN close IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) <= 0.10::DOUBLE AS kept FROM {p}_filled GROUP BY panel_id, ticker),
{p}_left AS (SELECT * FROM {p}_filled JOIN {p}_share USING (panel_id, ticker) WHERE kept),
{p}_clean AS (SELECT panel_id, ticker, date, close FROM {p}_left JOIN (SELECT panel_id, date FROM {p}_left GROUP BY panel_id, date HAVING count(close) = count(*)) USING (panel_id, date))"""



def windows(panel: str, bench: str) -> str:
    """CTEs panel and other, clean and aligned, of the windows of the relation r, whose runs name tickers, benchmark, start and end; ``panel`` and
    ``bench`` have source, ticker, date, close. A window's key is panel_id."""
    return f"""
asked AS (SELECT DISTINCT panel_id, source, tickers, benchmark, start, "end" FROM r WHERE start <= "end" AND len(tickers) > 0),
p AS (SELECT DISTINCT a.panel_id, x.ticker, x.date, CASE WHEN NOT isnan(x.close) THEN x.close END AS close FROM {panel} x JOIN asked a ON a.source = x.source AND list_contains(a.tickers, x.ticker) AND x.date BETWEEN a.start AND a."end"),
b AS (SELECT DISTINCT a.panel_id, x.ticker, x.date, x.close FROM {bench} x JOIN asked a ON a.source = x.source AND a.benchmark = x.ticker AND x.date BETWEEN a.start AND a."end"),{cleaned_by_panel("p", "p")},{cleaned_by_panel("b", "b")},
panel AS (SELECT * FROM p_clean SEMI JOIN b_clean USING (panel_id, date)),
other AS (SELECT * FROM b_clean SEMI JOIN p_clean USING (panel_id, date))"""


#: A run's window as text.
KEY = """concat_ws('|', source, list_sort(tickers)::VARCHAR, benchmark, start, "end") AS panel_id"""
SWEEP = f"""r AS (SELECT *, {KEY} FROM (SELECT weighting || '-' || rebalance || '-' || bps AS run_id, 'TYPE' AS source, {list(TICKERS)} AS tickers, {list(CUSTOM)}::DOUBLE[] AS weights, 'ALL' AS benchmark,
  DATE '1995-01-01' AS start, DATE '2001-12-31' AS "end", {CAPITAL} AS capital, weighting, rebalance, bps / 10000::DOUBLE AS rate, CASE WHEN weighting = 'inverse_vol' THEN 63 END AS lookback
  FROM (SELECT unnest({list(specs.WEIGHTINGS)}) AS weighting), (SELECT unnest({list(specs.REBALANCES)}) AS rebalance), (SELECT unnest([0, 10]) AS bps)))"""
SOURCES = f"""types AS (SELECT 'TYPE' AS source, * FROM ({prices("p_type")})), bench AS (SELECT 'TYPE' AS source, * FROM ({BENCHMARK}))"""

#: Trades and weights of the runs of r on the panels of their windows.
RUNS = f"""
runs AS (SELECT * FROM r WHERE NOT (weighting = 'custom' AND EXISTS (SELECT 1 FROM (SELECT unnest(r.tickers) AS ticker) t WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.panel_id = r.panel_id AND p.ticker = t.ticker)))
  AND (SELECT count(DISTINCT date) FROM panel p WHERE p.panel_id = r.panel_id) > CASE WHEN weighting = 'inverse_vol' THEN lookback + 1 ELSE 1 END),
places AS (SELECT panel_id, date, row_number() OVER (PARTITION BY panel_id ORDER BY date) - 1 AS place FROM (SELECT DISTINCT panel_id, date FROM panel)),
dates AS (SELECT r.*, date, place FROM runs r JOIN places USING (panel_id) WHERE place >= coalesce(lookback, 0)),
periods AS (SELECT run_id, max(date) AS rebalance_date FROM dates WHERE rebalance <> 'none'
  GROUP BY run_id, date_trunc(CASE rebalance WHEN 'monthly' THEN 'month' WHEN 'quarterly' THEN 'quarter' ELSE 'year' END, date)),
ends AS (SELECT run_id, min(date) AS lo, max(date) AS hi FROM dates GROUP BY run_id),
trades AS (SELECT run_id, lo AS rebalance_date FROM ends UNION ALL SELECT run_id, rebalance_date FROM periods JOIN ends USING (run_id) WHERE rebalance_date > lo AND rebalance_date < hi),
rets AS (SELECT panel_id, ticker, place, close / lag(close) OVER (PARTITION BY panel_id, ticker ORDER BY date) - 1 AS ret FROM panel JOIN places USING (panel_id, date)),
sigmas AS (SELECT t.run_id, rebalance_date, ticker, stddev_samp(ret) AS sigma FROM trades t JOIN dates d ON d.run_id = t.run_id AND d.date = t.rebalance_date
  JOIN rets x ON x.panel_id = d.panel_id AND x.place BETWEEN d.place - d.lookback + 1 AND d.place WHERE weighting = 'inverse_vol' GROUP BY ALL),
raw_weights AS (
  SELECT run_id, panel_id, rebalance_date, ticker, CASE weighting WHEN 'equal' THEN 1::DOUBLE WHEN 'custom' THEN weights[list_position(tickers, ticker)] ELSE CASE WHEN sigma > 0 THEN 1 / sigma ELSE 0 END END AS raw
  FROM trades JOIN runs USING (run_id) JOIN (SELECT DISTINCT panel_id, ticker FROM panel) USING (panel_id) LEFT JOIN sigmas USING (run_id, rebalance_date, ticker)),
targets AS (SELECT *, raw / sum(raw) OVER (PARTITION BY run_id, rebalance_date) AS weight FROM raw_weights)"""


def valued(r: str, sources: str = SOURCES, panel: str = "types", bench: str = "bench") -> str:
    """CTEs up to nav, the daily values of the runs ``r``."""
    return f"""{r}, {sources}, {windows(panel, bench)}, {RUNS},
units AS (SELECT t.*, weight / close AS units FROM targets t JOIN panel p ON p.panel_id = t.panel_id AND p.ticker = t.ticker AND p.date = t.rebalance_date),
days AS (
  SELECT d.run_id, d.panel_id, d.date, d.rate, d.capital, t.rebalance_date IS NOT NULL AS is_trade,
         max(t.rebalance_date) OVER (PARTITION BY d.run_id ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS in_force
  FROM dates d LEFT JOIN trades t ON t.run_id = d.run_id AND t.rebalance_date = d.date),
held AS (SELECT d.run_id, d.date, d.is_trade, u.ticker, u.units * p.close AS part FROM days d JOIN units u ON u.run_id = d.run_id AND u.rebalance_date = d.in_force
  JOIN panel p ON p.panel_id = d.panel_id AND p.ticker = u.ticker AND p.date = d.date),
growth AS (SELECT run_id, date, sum(part) AS growth FROM held GROUP BY run_id, date),
turn AS (SELECT h.run_id, h.date, 0.5 * sum(abs(t.weight - h.part / g.growth)) AS turnover FROM held h JOIN growth g USING (run_id, date)
  JOIN targets t ON t.run_id = h.run_id AND t.ticker = h.ticker AND t.rebalance_date = h.date WHERE h.is_trade GROUP BY h.run_id, h.date),
steps AS (SELECT d.*, growth, CASE WHEN in_force IS NULL THEN 1::DOUBLE ELSE coalesce(turnover, 0) END AS turnover FROM days d LEFT JOIN growth USING (run_id, date) LEFT JOIN turn USING (run_id, date)),
based AS (SELECT *, product(CASE WHEN in_force IS NULL THEN capital * (1 - rate * turnover) WHEN is_trade THEN growth * (1 - rate * turnover) ELSE 1 END) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS base FROM steps),
worth AS (SELECT *, CASE WHEN in_force IS NULL OR is_trade THEN base ELSE base * growth END AS portfolio_value,
  CASE WHEN turnover > 0 THEN coalesce(lag(base) OVER (PARTITION BY run_id ORDER BY date), capital) * coalesce(growth, 1) * turnover * rate ELSE 0 END AS costs_paid FROM based),
nav AS (
  SELECT w.run_id, w.date, portfolio_value, coalesce(portfolio_value / lag(portfolio_value) OVER v - 1, 0) AS portfolio_return,
         capital * o.close / first_value(o.close) OVER v AS benchmark_value, coalesce(o.close / lag(o.close) OVER v - 1, 0) AS benchmark_return, turnover, costs_paid
  FROM worth w JOIN other o USING (panel_id, date) WINDOW v AS (PARTITION BY w.run_id ORDER BY w.date))"""


NAV = valued(SWEEP)
_window_runs = ", ".join(
    f"('{i}-{j}-{w}', {[TICKERS[k] for k in places]}, {[float(k + 1) / sum(range(len(places) + 1)) for k in range(len(places))]}::DOUBLE[], DATE '{start}', DATE '{end}', '{w}', {21 + 21 * j if w == 'inverse_vol' else 'NULL'})"
    for i, places in enumerate(SUBSETS) for j, (start, end) in enumerate(SPANS) for w in specs.WEIGHTINGS
)
WINDOW_RUNS = f"""r AS (SELECT *, {KEY} FROM (SELECT v.*, 'TYPE' AS source, 'ALL' AS benchmark, {CAPITAL} AS capital, 'monthly' AS rebalance, 10 / 10000::DOUBLE AS rate
  FROM (VALUES {_window_runs}) v(run_id, tickers, weights, start, "end", weighting, lookback)))"""

BOTH = """both_series AS (SELECT run_id, 'portfolio' AS series, date, portfolio_return AS ret, benchmark_return AS other FROM nav
  UNION ALL SELECT run_id, 'benchmark', date, benchmark_return, benchmark_return FROM nav)"""


def weights_sql(scheme: str) -> str:
    return f"WITH {SWEEP}, {SOURCES}, {windows('types', 'bench')}, {RUNS} SELECT run_id, rebalance_date, ticker, round(weight, 8) AS weight FROM targets WHERE run_id LIKE '{scheme}-%-0'"


def ticks_sql(column: str) -> str:
    return f"SELECT CAST({column} AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, round(arg_max(value, (ts, event_id)), 8) AS close FROM events GROUP BY 1, 2"


def uniform(tag: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', 0, path, step, '{tag}')), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def draws_sql(n_paths: int, n_steps: int, lengths: str) -> str:
    return f"""counters AS (SELECT path, step FROM (SELECT unnest(range({n_paths})) AS path), (SELECT unnest(range({n_steps})) AS step)),
marks AS (SELECT path, step, step = 0 OR {uniform("new")} < 1.0::DOUBLE / 21 AS new, {uniform("start")} AS u FROM counters),
begun AS (SELECT path, step, last_value(CASE WHEN new THEN step END IGNORE NULLS) OVER v AS from_step, last_value(CASE WHEN new THEN u END IGNORE NULLS) OVER v AS u
  FROM marks WINDOW v AS (PARTITION BY path ORDER BY step ROWS UNBOUNDED PRECEDING)),
draws AS (SELECT n_obs, path, step, (floor(u * n_obs)::BIGINT + step - from_step) % n_obs AS idx FROM begun, ({lengths}))"""


NUMBERED = f"""{TYPE_RETURNS},
numbered AS (SELECT * FROM (SELECT ticker, ret, other, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY ticker) AS n_obs
  FROM rets WHERE ret IS NOT NULL AND other IS NOT NULL) WHERE n_obs >= 21)"""


def paths_sql(n_paths: int) -> str:
    return f"""{NUMBERED}, {draws_sql(n_paths, 1260, "SELECT DISTINCT n_obs FROM numbered")},
wealth AS (SELECT ticker, path, step, {CAPITAL} * product(1 + ret) OVER v AS value, {CAPITAL} * product(1 + other) OVER v AS other_value
  FROM draws JOIN numbered USING (n_obs, idx) WINDOW v AS (PARTITION BY ticker, path ORDER BY step ROWS UNBOUNDED PRECEDING))"""


def bootstrap_sql(n_paths: int) -> dict[str, str]:
    return {
        "bootstrap_horizons": f"""WITH {paths_sql(n_paths)} SELECT ticker, ((step + 1) / 252)::INTEGER AS years, round(quantile_cont(value, 0.5), 2) AS median, round(quantile_cont(value, 0.1), 2) AS p10, round(quantile_cont(value, 0.9), 2) AS p90,
  round(avg(CASE WHEN value < {CAPITAL} THEN 1.0::DOUBLE ELSE 0 END), 8) AS p_below, round(avg(CASE WHEN value > other_value THEN 1.0::DOUBLE ELSE 0 END), 8) AS p_beats, round(quantile_cont(other_value, 0.5), 2) AS benchmark_median
FROM wealth WHERE step IN (251, 755, 1259) GROUP BY ticker, step""",
        "bootstrap_fan": f"""WITH {paths_sql(n_paths)} SELECT ticker, step, round(quantile_cont(value, 0.1), 2) AS p10, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.9), 2) AS p90, round(quantile_cont(other_value, 0.5), 2) AS benchmark_p50
FROM wealth WHERE step % 5 = 0 GROUP BY ticker, step""",
    }


EPISODES = f"""{TYPE_RETURNS}, dd AS ({curve("rets", "ticker")}),
marked AS (SELECT *, drawdown < 0 AS under, coalesce(lag(date) OVER v, date) AS before, lead(date) OVER v AS after,
  CASE WHEN drawdown < 0 AND NOT coalesce(lag(drawdown) OVER v < 0, false) THEN 1 ELSE 0 END AS starts FROM dd WINDOW v AS (PARTITION BY ticker ORDER BY date)),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS episode FROM marked),
episodes AS (SELECT ticker, min(before) AS peak, arg_min(date, (drawdown, date)) AS trough, max_by(coalesce(after, DATE '9999-12-31'), date) AS after, min(drawdown) AS depth, count(*) AS days
  FROM islands WHERE under GROUP BY ticker, episode),
closed AS (SELECT ticker, peak, trough, nullif(after, DATE '9999-12-31') AS recovery, depth, CASE WHEN after < DATE '9999-12-31' THEN days END AS days_to_recover FROM episodes)"""

TAPE = f"""lines AS (SELECT 'TAPE' AS ticker, year(l_shipdate)::INTEGER AS year, (l_discount - 0.05::DOUBLE) / 100 AS ret,
  row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount) AS date FROM lineitem)"""
TAPE_EPISODES = f"""{TAPE}, curves AS ({curve("lines", "ticker")}), dry AS (SELECT *, max(CASE WHEN drawdown >= 0 THEN date END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM curves),
wet AS (SELECT ticker, peak, arg_min(date, (drawdown, date)) AS trough, min(drawdown) AS depth, count(*) AS days, max(date) + 1 AS after FROM dry WHERE drawdown < 0 GROUP BY ticker, peak)"""

_customer = """SELECT c_name AS run_id, CASE WHEN c_custkey % 17 = 3 THEN [] WHEN c_custkey % 17 = 4 THEN ['A', '', 'B', 'C']
    ELSE [trim(upper(c_mktsegment)), 'ALL', 'N' || (c_nationkey % 5), CASE WHEN c_custkey % 7 = 0 THEN 'ALL' ELSE 'X' END] END AS tickers,
  CASE WHEN c_custkey % 2 = 0 THEN 'SPX' ELSE 'SPY' END AS benchmark, CASE WHEN c_custkey % 11 < 5 THEN DATE '1995-01-02' END AS start,
  CASE WHEN c_custkey % 19 = 5 THEN NULL WHEN c_custkey % 5 = 0 THEN DATE '1994-01-01' ELSE DATE '2000-12-31' END AS "end", c_acctbal AS capital,
  CASE c_custkey % 4 WHEN 0 THEN 'equal' WHEN 1 THEN 'custom' WHEN 2 THEN 'inverse_vol' ELSE 'market' END AS weighting,
  CASE c_custkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'annual' ELSE 'weekly' END AS rebalance, c_nationkey - 2 AS bps, c_custkey % 23 <> 6 AS has_rate,
  CASE WHEN c_custkey % 24 = 9 THEN [0.5, 0.5] WHEN c_custkey % 8 = 1 THEN [0.25, 0.25, 0.25, 0.25] WHEN c_custkey % 8 = 5 THEN [0.5, 0.25, 0.5, -0.5] END AS w,
  CASE WHEN c_custkey % 12 <> 10 THEN c_custkey % 6 END AS lookback,
  list_filter([CASE WHEN c_custkey % 10 = 0 THEN 'colour' END, CASE WHEN c_custkey % 15 = 0 THEN 'currency' END], lambda k: k IS NOT NULL) AS keys, c_custkey % 29 AS odd FROM customer WHERE c_custkey % 29 NOT IN (19, 23)"""
_rules = {
    "tickers missing": "len(tickers) = 0", "tickers blank": "list_contains(tickers, '')", "tickers duplicated": "len(list_distinct(tickers)) < len(tickers)",
    "start not a date": "start IS NULL", "end not a date": '"end" IS NULL', "start not before end": 'start >= "end"', "risk_free_rate missing": "NOT has_rate",
    "initial_capital not positive": "capital <= 0", "transaction_cost_bps negative": "bps < 0", "weighting unknown": f"weighting NOT IN {specs.WEIGHTINGS}",
    "rebalance unknown": f"rebalance NOT IN {specs.REBALANCES}", "custom_weights missing": "weighting = 'custom' AND w IS NULL",
    "custom_weights not one per ticker": "weighting = 'custom' AND len(w) <> len(tickers)", "custom_weights negative": "weighting = 'custom' AND list_min(w) < 0",
    "custom_weights do not sum to one": "weighting = 'custom' AND abs(list_sum(w) - 1) > 1e-6", "lookback_days missing": "weighting = 'inverse_vol' AND lookback IS NULL",
    "lookback_days below two": "weighting = 'inverse_vol' AND lookback < 2", "unknown keys": "len(keys) > 0",
}

# Definitions of the wrong type: each breaks its own rule and no other of its key.
_wrong = {
    "initial_capital not a number": ("initial_capital", "odd = 3"), "risk_free_rate not a number": ("risk_free_rate", "odd = 7 AND has_rate"), "lookback_days not a whole number": ("lookback_days", "odd = 11 AND lookback IS NOT NULL"),
    "tickers not a list": ("tickers", "odd = 13"), "custom_weights not a list of numbers": ("custom_weights", "odd = 17 AND w IS NOT NULL"),
}
for _rule, (_key, _odd_type) in _wrong.items():
    _rules |= {name: f"({rule}) AND NOT ({_odd_type})" for name, rule in _rules.items() if name.startswith(_key)}
_rules |= {
    rule: f"{odd}" + {"lookback_days": " AND weighting = 'inverse_vol'", "custom_weights": " AND weighting = 'custom'"}.get(key, "") for rule, (key, odd) in _wrong.items()
} | {"custom_weights not one per ticker": f"{_rules['custom_weights not one per ticker']} AND odd <> 13"}

_panels = ("TYPE", *FAULTS)
_odd = "(date - DATE '1990-01-01') % 20 < 10"


_promo = "ticker = 'PROMO' AND date_trunc('month', date) = DATE '1996-01-01'"
_list = list(TICKERS)
FAULTY = f"""kinds AS (SELECT unnest({list(_panels)}) AS source),
faulty AS (SELECT source, ticker, date, CASE WHEN source = 'FLAT' THEN 100 WHEN source = 'SUNK' THEN close - 105 WHEN source = 'NONE' OR source = 'THIN' AND {_odd} THEN NULL
    WHEN source = 'HOLES' AND (date - DATE '1990-01-01') % 20 = 0 THEN 'nan'::DOUBLE WHEN source = 'ENDLESS' AND {_promo} THEN 'inf'::DOUBLE ELSE close END AS close,
    source = 'TWICE' AND {_promo} AS twice FROM ({prices("p_type")}), kinds WHERE source <> 'LATE' OR date >= DATE '{LATE_DAY}'),
faulty_bench AS (SELECT source, ticker, CASE WHEN source = 'APART' THEN date + 36500 ELSE date END AS date, CASE WHEN source = 'BENCH' AND {_odd} THEN NULL ELSE close END AS close
  FROM ({BENCHMARK}), kinds WHERE source <> 'SHORT' OR date = DATE '{WINDOW[0]}')"""
#: Those of the faulty runs that are sound.
SOUND_RUNS = f"""r AS (SELECT *, {KEY} FROM (SELECT v.*, {_list} AS tickers, {list(CUSTOM)}::DOUBLE[] AS weights, 'ALL' AS benchmark, {CAPITAL} AS capital, 'monthly' AS rebalance, 10 / 10000::DOUBLE AS rate, 63 AS lookback_
    FROM (SELECT k || '-' || w AS run_id, k AS source, w AS weighting, DATE '1995-01-01' AS start, DATE '2001-12-31' AS "end" FROM (SELECT unnest(['TYPE', 'FLAT', 'HOLES']) AS k), (SELECT unnest({list(specs.WEIGHTINGS)}) AS w)
      WHERE k <> 'FLAT' OR w <> 'inverse_vol'
    UNION ALL VALUES ('own-order', 'TYPE', 'equal', DATE '1995-01-01', DATE '2001-12-31')
    UNION ALL SELECT 'own-window-' || w, 'TYPE', w, DATE '{WINDOW[0]}', DATE '{WINDOW[1]}' FROM (SELECT unnest({list(specs.WEIGHTINGS)}) AS w)) v),
  LATERAL (SELECT CASE WHEN weighting = 'inverse_vol' THEN lookback_ END AS lookback))"""
PROBLEMS = f"""{FAULTY},
own AS (SELECT * FROM (VALUES ('own-ticker', ['PROMO', 'GONE'], 'ALL', DATE '1995-01-01', DATE '2001-12-31', 100000, 'equal', NULL), ('own-benchmark', {_list}, 'GONE', DATE '1995-01-01', DATE '2001-12-31', 100000, 'equal', NULL),
    ('own-start', {_list}, 'ALL', DATE '1990-01-01', DATE '2001-12-31', 100000, 'equal', NULL), ('own-capital', {_list}, 'ALL', DATE '1995-01-01', DATE '2001-12-31', 0, 'equal', NULL),
    ('own-lookback', {_list}, 'ALL', DATE '1995-01-01', DATE '2001-12-31', 100000, 'inverse_vol', 4000), ('own-infinite', {_list}, 'ALL', DATE '1995-01-01', DATE '2001-12-31', 100000, 'equal', NULL),
    ('own-order', {_list}, 'ALL', DATE '1995-01-01', DATE '2001-12-31', 100000, 'equal', NULL), ('own-window-equal', {_list}, 'ALL', DATE '{WINDOW[0]}', DATE '{WINDOW[1]}', 100000, 'equal', NULL),
    ('own-window-custom', {_list}, 'ALL', DATE '{WINDOW[0]}', DATE '{WINDOW[1]}', 100000, 'custom', NULL), ('own-window-inverse_vol', {_list}, 'ALL', DATE '{WINDOW[0]}', DATE '{WINDOW[1]}', 100000, 'inverse_vol', 63)
  ) v(run_id, tickers, benchmark, start, "end", capital, weighting, lookback)),
r AS (SELECT *, {KEY} FROM (SELECT k || '-' || w AS run_id, k AS source, {_list} AS tickers, 'ALL' AS benchmark, DATE '1995-01-01' AS start, DATE '2001-12-31' AS "end", 100000 AS capital, w AS weighting, CASE WHEN w = 'inverse_vol' THEN 63 END AS lookback
      FROM (SELECT unnest({[*_panels, "ABSENT"]}) AS k), (SELECT unnest({list(specs.WEIGHTINGS)}) AS w)
  UNION ALL SELECT run_id, 'TYPE', tickers, benchmark, start, "end", capital, weighting, lookback FROM own)),{windows("faulty", "faulty_bench")},
wanted AS (SELECT run_id, panel_id, source, start, "end", 'ticker' AS what, unnest(tickers) AS ticker FROM r UNION ALL SELECT run_id, panel_id, source, start, "end", 'benchmark', benchmark FROM r),
firsts AS (SELECT 'ticker' AS what, panel_id, ticker, min(date) FILTER (WHERE close IS NOT NULL) AS first FROM p GROUP BY ALL UNION ALL SELECT 'benchmark', panel_id, ticker, min(date) FILTER (WHERE close IS NOT NULL) FROM b GROUP BY ALL),
odd AS (SELECT DISTINCT w.run_id, w.ticker, CASE WHEN twice THEN 'ticker with repeated days' ELSE 'ticker with infinite prices' END AS rule
  FROM wanted w JOIN faulty f ON w.what = 'ticker' AND f.source = w.source AND f.ticker = w.ticker AND f.date BETWEEN w.start AND w."end" WHERE twice OR close = 'inf'::DOUBLE),
kept AS (SELECT panel_id, count(*) FILTER (WHERE kept) AS kept FROM p_share GROUP BY panel_id),
shared AS (SELECT panel_id, count(DISTINCT date) AS shared, count(*) FILTER (WHERE close <= 0) AS bad, count(*) FILTER (WHERE close = 'inf'::DOUBLE) AS endless FROM panel GROUP BY panel_id),
complete AS (SELECT panel_id, count(*) AS complete FROM p_clean GROUP BY panel_id),
by_panel AS (
  SELECT panel_id, CASE WHEN kept = 0 THEN 'no ticker left' WHEN complete IS NULL THEN 'no date left' WHEN coalesce(shared, 0) < 2 THEN 'fewer than two shared dates' END AS rule
  FROM kept LEFT JOIN complete USING (panel_id) LEFT JOIN shared USING (panel_id)
  UNION ALL SELECT panel_id, 'non-positive prices' FROM shared WHERE bad > 0 UNION ALL SELECT panel_id, 'fewer than two dates' FROM shared WHERE shared < 2 UNION ALL SELECT panel_id, 'infinite prices' FROM shared WHERE endless > 0),
valid AS (SELECT * FROM r WHERE run_id NOT IN ('own-capital', 'own-infinite')),
days AS (SELECT run_id, panel_id, lookback, date, place FROM valid JOIN (SELECT panel_id, date, row_number() OVER (PARTITION BY panel_id ORDER BY date) - 1 AS place FROM (SELECT DISTINCT panel_id, date FROM panel)) USING (panel_id)
  WHERE weighting = 'inverse_vol' AND place >= lookback),
trades AS (SELECT run_id, panel_id, lookback, date FROM (SELECT *, max(date) OVER (PARTITION BY run_id, date_trunc('month', date)) AS month_end, min(date) OVER (PARTITION BY run_id) AS lo, max(date) OVER (PARTITION BY run_id) AS hi FROM days)
  WHERE date = lo OR date = month_end AND date < hi),
rets AS (SELECT panel_id, ticker, date, close / lag(close) OVER (PARTITION BY panel_id, ticker ORDER BY date) - 1 AS ret FROM panel SEMI JOIN (SELECT panel_id FROM r WHERE source NOT IN ('SUNK', 'ENDLESS')) USING (panel_id)),
sigmas AS (SELECT panel_id, date, max(sigma) AS sigma FROM (SELECT panel_id, date, stddev_samp(ret) OVER (PARTITION BY panel_id, ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS sigma FROM rets) GROUP BY ALL),
sizes AS (SELECT panel_id, count(DISTINCT date) AS n FROM panel GROUP BY panel_id),
problems AS (
  SELECT run_id, 'initial_capital not positive' AS rule, NULL AS subject FROM r WHERE capital <= 0
  UNION ALL SELECT * FROM (VALUES ('own-twice', 'run_id duplicated', NULL), (NULL, 'run_id missing', NULL), ('own-infinite', 'initial_capital not finite', NULL))
  UNION ALL SELECT run_id, 'panel without prices', source FROM r WHERE panel_id NOT IN (SELECT panel_id FROM p)
  UNION ALL SELECT run_id, what || CASE WHEN first IS NULL THEN ' without prices' ELSE ' starts late' END, ticker FROM wanted LEFT JOIN firsts USING (what, panel_id, ticker) WHERE first IS NULL OR first > start + 7
  UNION ALL SELECT run_id, 'benchmark dropped', benchmark FROM r JOIN b_share s ON s.panel_id = r.panel_id AND s.ticker = r.benchmark WHERE NOT kept
  UNION ALL SELECT run_id, rule, ticker FROM odd
  UNION ALL SELECT run_id, rule, source FROM r JOIN by_panel USING (panel_id) WHERE rule IS NOT NULL
  UNION ALL SELECT run_id, 'a ticker of a custom run was dropped', ticker FROM (SELECT run_id, panel_id, unnest(tickers) AS ticker FROM valid WHERE weighting = 'custom') ANTI JOIN panel USING (panel_id, ticker)
  UNION ALL SELECT run_id, 'history too short for the lookback', coalesce(n, 0)::VARCHAR FROM valid LEFT JOIN sizes USING (panel_id) WHERE weighting = 'inverse_vol' AND coalesce(n, 0) <= lookback + 1
  UNION ALL SELECT run_id, 'no ticker with a usable deviation', date::VARCHAR FROM trades JOIN sigmas USING (panel_id, date) WHERE coalesce(sigma, 0) <= 0)"""

BRANDS = f"brands AS ({prices('p_brand')}),{cleaning('brands', 'c')}"



def without_negative_zero(sql: str) -> str:
    """Every round(...) plus 0: Spark has no negative zero there."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j = 1, i + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += sql[at:i] + f"(round({without_negative_zero(sql[i + len('round('):j - 1])}) + 0)"
        at = j
    return out + sql[at:]


ORACLE = {
    "instrument_summary": f"""WITH types AS ({prices("p_type")}), dd AS ({curve("(" + returns_of("types") + ")", "ticker")})
SELECT ticker, count(*) AS days, round(pow(product(1 + coalesce(ret, 0)), 252::DOUBLE / count(*)) - 1, 8) AS cagr,
  round(CASE WHEN stddev_samp(ret) < 1e-12 THEN 0 ELSE stddev_samp(ret) * sqrt(252::DOUBLE) END, 8) AS volatility, round(min(drawdown), 8) AS max_drawdown FROM dd GROUP BY ticker""",
    "universe_window": f"""WITH brands AS ({prices("p_brand")}) SELECT 'BRANDS' AS panel_id, ticker, count(*) AS days, min(date) AS first_date, max(date) AS last_date, round(avg(close), 8) AS mean_close
FROM brands WHERE date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}' GROUP BY ticker""",
    "missing_tickers": f"""WITH names AS ({prices("p_name")}), asked AS (
  SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS start, p_name AS ticker FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
SELECT CAST(start AS VARCHAR) AS panel_id, ticker FROM asked WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.ticker = asked.ticker AND n.date BETWEEN asked.start AND asked.start + 6)""",
    "clean_panel": f"WITH {BRANDS} SELECT 'BRAND' AS panel_id, ticker, date, round(close, 8) AS close FROM c_clean",
    "dropped_tickers": f"WITH {BRANDS} SELECT 'BRAND' AS panel_id, ticker, round(missing_share, 8) AS missing_share, missing_share <= 0.10::DOUBLE AS kept FROM c_share",
    "coverage_violations": f"""WITH brands AS ({prices("p_brand")}) SELECT 'BRAND' AS panel_id, ticker, min(date) AS first_date, 'starts late' AS reason
FROM brands GROUP BY ticker HAVING min(date) > DATE '{BRANDS_FROM}' + 7""",
    "panel_facts": f"""WITH {BRANDS}, by_date AS (SELECT date, count(*) FILTER (WHERE kept) AS a, count(*) FILTER (WHERE kept AND close IS NOT NULL) AS have, count(*) AS n FROM c_marked GROUP BY date)
SELECT 'BRAND' AS panel_id, count(*) AS dates, max(n) AS tickers, max(a) AS tickers_kept, count(*) FILTER (WHERE a > 0 AND have = a) AS complete_dates, count(*) FILTER (WHERE a > 0 AND have < a) AS dropped_dates FROM by_date""",
    "panel_violations": """WITH day AS (SELECT CAST(user_id AS VARCHAR) AS panel_id, event_type AS ticker, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2, 3),
p AS (SELECT * FROM day WHERE ticker <> 'error'), b AS (SELECT * FROM day WHERE ticker = 'error'),
grid AS (SELECT d.panel_id, d.date, t.ticker, s.close FROM (SELECT DISTINCT panel_id, date FROM p) d JOIN (SELECT DISTINCT panel_id, ticker FROM p) t USING (panel_id) LEFT JOIN p s USING (panel_id, date, ticker)),
facts AS (SELECT panel_id, count(*) FILTER (WHERE close IS NULL) AS missing, count(*) FILTER (WHERE close <= 0) AS bad, count(DISTINCT date) AS dates FROM grid GROUP BY panel_id),
series AS (SELECT panel_id, count(DISTINCT ticker) AS n FROM b GROUP BY panel_id),
odd AS (SELECT DISTINCT panel_id FROM (SELECT DISTINCT panel_id, date FROM p) x FULL JOIN (SELECT DISTINCT panel_id, date FROM b) y USING (panel_id, date) WHERE x.date IS NULL OR y.date IS NULL),
every AS (SELECT DISTINCT panel_id FROM day), joined AS (SELECT * FROM every LEFT JOIN facts USING (panel_id) LEFT JOIN series USING (panel_id))
SELECT panel_id, 'no prices' AS rule FROM joined WHERE dates IS NULL UNION ALL SELECT panel_id, 'missing prices' FROM joined WHERE missing > 0
UNION ALL SELECT panel_id, 'non-positive prices' FROM joined WHERE bad > 0 UNION ALL SELECT panel_id, 'dates differ from the benchmark' FROM odd
UNION ALL SELECT panel_id, 'fewer than two dates' FROM joined WHERE dates < 2 UNION ALL SELECT panel_id, 'not exactly one benchmark series' FROM joined WHERE coalesce(n, 0) <> 1""",
    "aligned_dates": f"""WITH brands AS ({prices("p_brand")}), urgent AS (SELECT 'URGENT' AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY 2)
SELECT 'BRAND' AS panel_id, ticker, date, round(close, 4) AS close FROM (
  SELECT * FROM brands WHERE date IN (SELECT date FROM urgent) UNION ALL SELECT * FROM urgent WHERE date IN (SELECT date FROM brands))""",
    "daily_returns": f"WITH {TYPE_RETURNS} SELECT ticker, date, round(ret, 8) AS ret, round(ret - {RATE}, 8) AS excess, round(ret - other, 8) AS active FROM rets",
    "drawdown_curve": f"WITH {TYPE_RETURNS}, dd AS ({curve('rets', 'ticker')}) SELECT ticker, date, round(curve, 8) AS curve, round(drawdown, 8) AS drawdown FROM dd",
    "drawdown_episodes": f"WITH {EPISODES} SELECT ticker, peak, trough, recovery, round(depth, 8) AS depth, days_to_recover FROM closed",
    "top_drawdowns": f"""WITH {EPISODES} SELECT ticker, peak, trough, recovery, round(depth, 8) AS depth, days_to_recover, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY depth, peak)::INTEGER AS rank FROM closed) WHERE rank <= 3""",
    "rolling_sharpe": f"""WITH {TYPE_RETURNS} SELECT ticker, date, round(CASE WHEN count(ret) OVER v = 252 THEN avg(ret - {RATE}) OVER v / nullif(stddev_samp(ret - {RATE}) OVER v, 0) * sqrt(252::DOUBLE) END, 6) AS rolling_sharpe
FROM rets WINDOW v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""",
    "monthly_grid": f"""WITH {TYPE_RETURNS}, m AS (SELECT ticker, year(date)::INTEGER AS year, month(date) AS month, product(1 + ret) - 1 AS ret FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2, 3)
SELECT ticker, year, {", ".join(f"round(max(ret) FILTER (WHERE month = {k}), 8) AS m{k}" for k in range(1, 13))} FROM m GROUP BY ticker, year""",
    "instrument_measures": f"WITH {TYPE_RETURNS} SELECT ticker, {rounds(MEASURE_DIGITS)} FROM ({measures('rets', 'ticker')})",
    "instrument_measures_long": f"""WITH {TYPE_RETURNS}, wide AS ({measures("rets", "ticker")}) {" UNION ALL ".join(f"SELECT ticker, '{m}' AS measure, round({m}, 8) AS value FROM wide" for m in MEASURE_DIGITS)}""",
    "tape_episodes": f"""WITH {TAPE_EPISODES} SELECT ticker, peak, trough, CASE WHEN after <= (SELECT max(date) FROM lines) THEN after END AS recovery, round(depth, 8) AS depth,
  CASE WHEN after <= (SELECT max(date) FROM lines) THEN days END AS days_to_recover FROM wet""",
    "tape_rolling": f"""WITH {TAPE}, r AS (SELECT ticker, year, CASE WHEN count(ret) OVER v = 252 THEN avg(ret - {RATE}) OVER v / nullif(stddev_samp(ret - {RATE}) OVER v, 0) * sqrt(252::DOUBLE) END AS s
  FROM lines WINDOW v AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
SELECT ticker, year, count(s) AS ticks, round(min(s), 5) AS least, round(max(s), 5) AS most, round(avg(s), 5) AS mean FROM r GROUP BY ticker, year""",
    "asof_quotes": """WITH q AS (SELECT user_id, ts, max(event_id) AS quote_id, arg_max(value, event_id) AS quote_value FROM events WHERE event_type = 'error' GROUP BY user_id, ts)
SELECT e.user_id, e.event_id, q.quote_id, q.quote_value FROM events e ASOF LEFT JOIN q ON e.user_id = q.user_id AND e.ts >= q.ts WHERE e.event_type <> 'error'""",
    "tail_risk": f"""WITH r AS (SELECT l_returnflag AS ticker, l_extendedprice * (l_discount - 0.05::DOUBLE) / 100000::DOUBLE AS ret FROM lineitem),
c AS (SELECT unnest({list(CONFIDENCES)}::DOUBLE[]) AS confidence), q AS (SELECT ticker, 0.95::DOUBLE AS confidence, quantile_cont(ret, {TAIL}) AS tail FROM r GROUP BY ticker
  UNION ALL SELECT ticker, 0.99::DOUBLE, quantile_cont(ret, 0.010000000000000009::DOUBLE) FROM r GROUP BY ticker)
SELECT ticker, confidence, round(-max(tail), 8) AS value_at_risk, round(-avg(ret), 8) AS expected_shortfall FROM r JOIN q USING (ticker) JOIN c USING (confidence) WHERE ret <= tail GROUP BY ticker, confidence""",
    "measures_by_state": f"WITH {TYPE_RETURNS} SELECT ticker, {rounds({m: d for m, d in MEASURE_DIGITS.items() if m not in ('var_95', 'cvar_95')})} FROM ({measures('rets', 'ticker')})",
    "rebalance_calendar": f"""WITH brands AS ({prices("p_brand")}), d AS (SELECT ticker AS calendar_id, date, f AS frequency FROM brands, (SELECT unnest(['monthly', 'quarterly', 'annual']) AS f)),
ends AS (SELECT calendar_id, min(date) AS lo, max(date) AS hi FROM d GROUP BY calendar_id),
last AS (SELECT calendar_id, frequency, max(date) AS rebalance_date FROM d GROUP BY calendar_id, frequency, date_trunc(CASE frequency WHEN 'monthly' THEN 'month' WHEN 'quarterly' THEN 'quarter' ELSE 'year' END, date))
SELECT calendar_id, frequency, rebalance_date FROM last JOIN ends USING (calendar_id) WHERE rebalance_date > lo AND rebalance_date < hi""",
    "weights_equal": weights_sql("equal"), "weights_custom": weights_sql("custom"), "weights_inverse_vol": weights_sql("inverse_vol"),
    "nav_daily": f"""WITH {NAV} SELECT run_id, date, {rounds({"portfolio_value": 2, "portfolio_return": 8, "benchmark_value": 2, "benchmark_return": 8, "turnover": 8, "costs_paid": 4})} FROM nav""",
    "windowed_nav": f"""WITH {valued(WINDOW_RUNS)} SELECT run_id, date, {rounds({"portfolio_value": 2, "portfolio_return": 8, "benchmark_value": 2, "benchmark_return": 8, "turnover": 8, "costs_paid": 4})} FROM nav""",
    "comparison_table": f"WITH {NAV}, {BOTH} SELECT run_id, series, {rounds(dict.fromkeys(MEASURE_DIGITS, 6))} FROM ({measures('both_series', 'run_id, series')})",
    "headline": f"""WITH {NAV}, {BOTH}, m AS ({measures("both_series", "run_id, series")}),
facts AS (SELECT run_id, max_by(portfolio_value, date) AS final_value, max_by(benchmark_value, date) AS benchmark_final, max_by(portfolio_value, date) / min_by(portfolio_value, date) - 1 AS total_return,
  max_by(benchmark_value, date) / min_by(benchmark_value, date) - 1 AS benchmark_return FROM nav GROUP BY run_id),
s AS (SELECT run_id, max(sharpe) FILTER (WHERE series = 'portfolio') AS p, max(sharpe) FILTER (WHERE series = 'benchmark') AS b FROM m GROUP BY run_id)
SELECT run_id, round(final_value, 2) AS final_value, round(benchmark_final, 2) AS benchmark_final, round(total_return, 8) AS total_return, round(benchmark_return, 8) AS benchmark_return,
  total_return > benchmark_return AS beat_return, coalesce(p > b, false) AS beat_sharpe, total_return > benchmark_return AND coalesce(p > b, false) AS beat_both FROM facts JOIN s USING (run_id)""",
    "cost_summary": f"""WITH {NAV}, firsts AS (SELECT run_id, min(date) AS lo FROM nav GROUP BY run_id)
SELECT run_id, round(sum(costs_paid), 4) AS total_cost, round(min_by(costs_paid, date), 4) AS entry_cost, count(*) FILTER (WHERE turnover > 0) - 1 AS rebalances,
  round(coalesce(avg(turnover) FILTER (WHERE turnover > 0 AND date > lo), 0), 8) AS mean_turnover, round(sum(costs_paid) / {CAPITAL}, 8) AS cost_share FROM nav JOIN firsts USING (run_id) GROUP BY run_id""",
    "run_window": f"WITH {NAV} SELECT run_id, min(date) AS first_date, max(date) AS last_date, count(*) AS days, min(date) > DATE '1995-01-01' AS starts_late FROM nav GROUP BY run_id",
    "run_problems": f"WITH {PROBLEMS} SELECT DISTINCT run_id, rule, subject FROM problems",
    "sound_run_values": f"""WITH {valued(SOUND_RUNS, FAULTY, "faulty", "faulty_bench")}
SELECT run_id, max(date) AS last_date, round(max_by(portfolio_value, date), 2) AS final_value, round(min(portfolio_value), 2) AS least_value FROM nav GROUP BY run_id""",
    "measures_of_runs": f"""WITH {NAV}, {BOTH}, wide AS ({measures("both_series", "run_id, series")}), long AS (
  {" UNION ALL ".join(f"SELECT run_id, series, '{m}' AS measure, round({m}, 6) AS value FROM wide" for m in MEASURE_DIGITS)})
SELECT run_id, measure, max(value) FILTER (WHERE series = 'portfolio') AS portfolio, max(value) FILTER (WHERE series = 'benchmark') AS benchmark FROM long GROUP BY run_id, measure""",
    "spec_keys": f"SELECT run_id, array_to_string(keys, '|') AS unknown_keys FROM ({_customer}) WHERE len(keys) > 0",
    "stored_prices": f"""WITH brands AS ({prices("p_brand")}), stored AS (
  SELECT ticker, date, CASE WHEN year(date) IN (1995, 1998) THEN 2 * close WHEN date = DATE '{CORRECTED}' THEN close + 1 ELSE close END AS close, close AS first_close FROM brands
  UNION ALL SELECT DISTINCT 'NEW', date, 7, NULL FROM brands WHERE date = DATE '{CORRECTED}')
SELECT ticker, date, round(close, 8) AS close, round(first_close, 8) AS first_close FROM stored WHERE date BETWEEN DATE '1995-07-01' AND DATE '{WINDOW[1]}'""",
    "bucketed_summary": f"""WITH brands AS ({prices("p_brand")}), rets AS ({returns_of("brands")}), dd AS ({curve("rets", "ticker")})
SELECT ticker, count(*) AS days, round(max_by(curve, date), 7) AS growth, round(min(drawdown), 7) AS max_drawdown FROM dd GROUP BY ticker""",
    "readable_prices": f"""SELECT ticker AS subject, count(*) AS n, min(date) AS first_date FROM ({prices("p_brand")}) GROUP BY ticker UNION ALL SELECT 'unreadable', {STRAY_FILES}, NULL""",
    "stored_nav": f"WITH {NAV} SELECT run_id, count(*) AS days, round(sum(costs_paid), 2) AS costs, max(date) AS last_date FROM nav GROUP BY run_id",
    "stored_horizons": f"WITH {TYPE_RETURNS} SELECT ticker, year(date)::INTEGER AS year, round(product(1 + ret) - 1, 8) AS ret FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2",
    "safe_names": """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'ticker' ELSE trim(regexp_replace(replace(c_name, '#', '/') || '_' || c_mktsegment, '[^A-Za-z0-9]+', '_', 'g'), '_') || '_X' END AS name FROM customer""",
    "run_violations": f"""WITH year_brands AS ({prices("p_brand")}),{cleaning("year_brands", "y")},
specs AS (SELECT w || '-' || f || '-' || b AS run_id, w FROM (SELECT unnest({list(specs.WEIGHTINGS)}) AS w), (SELECT unnest({list(specs.REBALANCES)}) AS f), (SELECT unnest([0, 10]) AS b))
SELECT run_id, 'a ticker of a custom run was dropped' AS rule, ticker AS subject FROM specs, (SELECT unnest({list(TICKERS)}) AS ticker) WHERE w = 'custom' AND ticker NOT IN (SELECT ticker FROM y_clean)
UNION ALL SELECT run_id, 'history too short for the lookback', CAST(n AS VARCHAR) FROM specs, (SELECT count(DISTINCT date) AS n FROM y_clean) WHERE w = 'inverse_vol' AND n <= 4001""",
    "spec_violations": f"WITH s AS ({_customer}) " + " UNION ALL ".join(f"SELECT run_id, '{name}' AS rule FROM s WHERE {rule}" for name, rule in _rules.items()) + " UNION ALL SELECT DISTINCT NULL, 'line unreadable' FROM customer WHERE c_custkey % 29 IN (19, 23)",
    "spec_unreadable": """SELECT left(CASE WHEN c_custkey % 29 = 23 THEN '[' ELSE '' END || '{"run_id":"' || c_name || '","panel_id":"P"', 40) AS line FROM customer WHERE c_custkey % 29 IN (19, 23)""",
    "spec_normalised": f"""WITH s AS ({_customer}) SELECT run_id, CASE WHEN odd <> 13 THEN array_to_string(tickers, '|') END AS tickers, benchmark, start, "end", weighting, rebalance FROM s""",
    "benchmark_value": f"""WITH bench AS ({BENCHMARK}) SELECT date, round({CAPITAL} * close / first_value(close) OVER v, 4) AS benchmark_value, round(coalesce(close / lag(close) OVER v - 1, 0), 8) AS benchmark_return FROM bench WINDOW v AS (ORDER BY date)""",
    "bootstrap_draws": f"""WITH {NUMBERED}, {draws_sql(50, 252, "SELECT DISTINCT n_obs FROM numbered")} SELECT n_obs, path, sum(idx)::BIGINT AS sum_idx, min(idx) AS low, max(idx) AS high FROM draws GROUP BY n_obs, path""",
    "daily_close_from_ticks": ticks_sql("event_type"), "daily_close_by_user": ticks_sql("user_id"),
}

ORACLE = {name: without_negative_zero(sql) for name, sql in (ORACLE | bootstrap_sql(PATHS)).items()}
