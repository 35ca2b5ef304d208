"""riskweave: filing-text analytics expressed as Spark plans."""
