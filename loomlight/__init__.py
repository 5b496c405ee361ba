"""Set-at-a-time document retrieval and conversation analytics on Spark."""

__version__ = "0.1.0"
