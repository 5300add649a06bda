"""Training-data operators. Nothing outside this package imports it; it imports nothing outside it."""
