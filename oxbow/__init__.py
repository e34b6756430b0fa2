"""oxbow: a Spark-first analytics engine for logs, graphs, text and embeddings."""

__version__ = "0.1.0"
