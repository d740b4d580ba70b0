"""A property-graph and vector context-retrieval engine on Spark."""

VERSION = "0.1.0"
