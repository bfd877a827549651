"""tessaria: a PySpark-native engine for retrieval and corpus analytics."""
