"""Literature-graph and corpus analytics on Spark."""
