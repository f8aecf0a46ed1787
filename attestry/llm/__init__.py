"""Training-data operators: scans, searches, deduplication, classifiers and packing over document tables."""
