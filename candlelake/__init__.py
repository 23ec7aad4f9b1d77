"""candlelake: market time-series operators as DataFrame-in, DataFrame-out PySpark functions."""
