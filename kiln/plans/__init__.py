"""Specs (standards, mappings, rules), plan-time helpers and the query registry."""
