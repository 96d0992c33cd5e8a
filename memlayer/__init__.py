"""A memory and retrieval analytics engine on Spark."""
