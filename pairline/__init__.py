"""pairline: image-edit training data as Spark tables (prompts, candidates, scores, splits)."""
