"""A Spark-native engine for document text: cleaning, layout, chunking, checks."""
