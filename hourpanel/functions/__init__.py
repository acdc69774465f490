"""Column-level building blocks: clock, scores, null handling."""
