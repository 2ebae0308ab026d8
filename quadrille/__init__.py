"""Knowledge-graph analytics on Spark: graph store, query compiler, constraint validation, code facts, provenance and batch processing."""
