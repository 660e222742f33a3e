"""Privacy analytics on Spark: detect, classify, tokenize, redact, cross-check, audit and report."""
