"""DataFrame operators: DataFrames in, one DataFrame (or a bounded list) out."""
