"""Incremental runs: a processed ledger with exactly-once batches, a bucketed snapshot index, and file streams."""
