"""Material-content analytics on Spark DataFrames.

Parameter tables (min / mode / max per component) are cleaned, classified and
joined, expanded into keyed draws, and reduced to mergeable histograms,
percentiles, sensitivity measures and one long composition table.
"""
