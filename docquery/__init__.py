"""Document queries on Spark: mapped documents, an immutable query builder, snapshots and SQL objects."""
