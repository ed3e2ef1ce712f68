"""Cohort curation, slice statistics, embedding analytics and multi-label evaluation as Spark DataFrame jobs."""
