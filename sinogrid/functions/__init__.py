"""Column-level functions: hashes, cleaning rules, ray geometry."""
