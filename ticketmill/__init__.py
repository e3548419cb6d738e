"""Ticket knowledge and incident clusters as Spark DataFrame operators."""

__version__ = "0.1.0"
