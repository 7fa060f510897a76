"""Decision calibration, learned priors and dependency-graph analytics on Spark."""
