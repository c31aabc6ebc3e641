"""Headline archive jobs on Spark: extraction, identity, archive tables, reads, clustering, change feed and health."""
