"""Graph-reasoning datasets as DataFrames: generation, analytics, task queries, tokens, verification, streams."""
