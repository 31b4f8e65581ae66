"""Layered (bronze / silver / gold) data pipelines and analyses on PySpark."""
