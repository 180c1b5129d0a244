"""Stream-graph analytics on Spark: dataflow stages, routing, reductions and iterative patterns as DataFrame plans."""
