"""Training-data operators over free text, names and vectors; nothing outside this package imports it."""
