"""siftwork: a PySpark-native curation engine (see README.md)."""
