"""Operations analytics on Spark DataFrames: feeds, metrics, reconciliation, rules, retention."""
