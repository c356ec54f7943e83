"""Spark-first analytics for amplicon reads that span a compound tandem-repeat locus."""
