"""Graph-augmented retrieval over document collections, as Spark plans."""
