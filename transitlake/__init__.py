"""Transit-signal analytics on Spark: see README.md."""
