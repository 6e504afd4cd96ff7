"""Document analytics on Spark: text preparation, search, extraction, roll-ups and evaluation as DataFrame plans."""
