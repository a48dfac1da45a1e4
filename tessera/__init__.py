"""Panel analytics over long ``(trade_date, ts_code, ...)`` tables, as Spark DataFrame operators."""
