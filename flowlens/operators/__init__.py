"""Read-only queries over workflow tables: lists, timelines, metrics, health, lineage and audits."""
