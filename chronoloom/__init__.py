"""Chronoloom: time alignment and relational analytics as Spark DataFrame functions."""
