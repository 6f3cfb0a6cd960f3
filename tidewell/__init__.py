"""tidewell: feeds, search, graph, moderation and vector operators over post corpora, Spark-first."""
