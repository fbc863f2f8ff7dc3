"""Tidemark: analytics operators and domain results written as Spark DataFrame plans."""
