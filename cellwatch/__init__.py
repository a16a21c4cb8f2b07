"""Hourly activity analytics over a grid of map cells, expressed as Spark plans."""
