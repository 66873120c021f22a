"""Transit delay jobs on Spark: baselines, route indexes, arrival estimates and delay models as DataFrame plans."""
