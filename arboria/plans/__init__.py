"""Whole plans: building an index, answering queries, and the registered queries."""
