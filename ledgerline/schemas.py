"""Fixed schemas of the tables that jobs read and write."""

PRICES_RAW = "ticker string, ts timestamp_ntz, close double, seq bigint"
PRICES = "ticker string, date date, close double"
RUN_SPEC = (
    "run_id string, panel_id string, tickers array<string>, benchmark string, start date, end date, initial_capital double,"
    " weighting string, rebalance string, risk_free_rate double, transaction_cost_bps double, custom_weights array<double>,"
    " lookback_days int"
)
#: As users write them: dates and names not yet normalised.
RUN_SPEC_RAW = RUN_SPEC.replace("start date, end date", "start string, end string")
