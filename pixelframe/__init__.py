"""Image and array analytics as relations of pixels, on Spark."""
