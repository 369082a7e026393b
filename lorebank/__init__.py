"""Knowledge-library analytics on Spark: ingest, chunk, index, retrieve, ground, organise."""
