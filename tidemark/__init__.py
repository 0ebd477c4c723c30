"""tidemark: analytics, search, vector, graph and corpus operators as Spark DataFrame programs."""
