"""cuewright: time-aligned text analytics on Spark."""
