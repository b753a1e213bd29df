"""Graph, text and document analytics over linked data, on Spark."""
