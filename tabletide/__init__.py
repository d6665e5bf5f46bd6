"""Spark jobs over tabletop game logs."""
