"""PySpark analytics for human-mobility trajectories: DataFrame in, DataFrame out."""
