"""Attribute-filtered, partition-pruned nearest-neighbour analytics as Spark jobs."""
