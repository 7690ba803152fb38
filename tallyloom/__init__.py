"""Tallyloom: a Spark-native engine for tool-call logs, command output and training corpora."""

__version__ = "0.1.0"
