"""Callscope: API-traffic analytics written as PySpark DataFrame operators."""
