"""larkspur: a PySpark-native engine for versioned collections of recordings,
segments, labels, embeddings and events."""
