"""ledgerline: portfolio return, risk and valuation jobs as Spark DataFrame plans."""
