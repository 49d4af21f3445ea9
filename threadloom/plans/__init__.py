"""Registered queries: their inputs, Spark plans and check SQL."""
