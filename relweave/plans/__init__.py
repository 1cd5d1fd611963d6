"""Plan helpers: lineage cuts and partition sizing."""
