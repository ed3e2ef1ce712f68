"""DataFrame operators: DataFrame(s) in, DataFrame out, lazy, no driver-side data."""
