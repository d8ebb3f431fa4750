"""quern: versioned reference corpora on Spark: search, look-ups, citation graphs and calculators as DataFrame plans."""
