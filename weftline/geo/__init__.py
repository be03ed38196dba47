"""Geometry: WKB columns, and functions that run in the JVM on the JTS library that Spark ships."""
