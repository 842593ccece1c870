"""A PySpark engine that segments ordered axes by the density of point events."""
