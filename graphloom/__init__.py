"""graphloom: knowledge-graph construction and assessment as Spark DataFrame plans."""

__version__ = "0.1.0"
