"""Asset curation analytics on Spark: profiling, filtering, de-duplication, sampling and validation of collections."""
