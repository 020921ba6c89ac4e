"""recallbase: analytics over documents, embeddings, graphs and event logs on Spark."""
