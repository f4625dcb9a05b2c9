"""Trailmark: conversation and agent-trace analytics as declarative Spark plans."""

__version__ = "0.1.0"
