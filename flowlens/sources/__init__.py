"""Table schemas, readers, and the workflow tables derived from the synthetic star schema."""
