"""orrery: group-contrast, graph-curvature and effect-size analytics on Spark DataFrames."""
