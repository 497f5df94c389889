"""A Spark engine that treats the schema of data as data, and runs shape-driven queries."""
