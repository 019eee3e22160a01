"""Operations of training-data pipelines: splitting, deduplication, neighbours, leaks, mixing, truncation."""
