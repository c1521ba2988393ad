"""A Spark-native engine for media catalogues: parsing, resolution, archives, graph, retrieval and evaluation."""
