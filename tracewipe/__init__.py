"""tracewipe: find, remove and analyse identifying metadata in large corpora of files, on Spark."""
