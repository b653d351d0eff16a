"""girthline: Spark-native enumeration of elementary trapping sets in sparse bipartite graphs."""

__version__ = "0.1.0"
