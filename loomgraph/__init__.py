"""loomgraph: knowledge retrieval and code-graph analytics as Spark jobs."""
