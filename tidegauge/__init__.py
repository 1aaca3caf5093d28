"""Market-sector lifecycle and valuation analytics as Spark DataFrame operators."""
