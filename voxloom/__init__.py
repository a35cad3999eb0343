"""voxloom: Spark-native analytics for labelled time intervals, embeddings and speech text."""

__version__ = "0.1.0"
