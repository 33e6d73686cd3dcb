"""Logical plans: staging, marts, query catalogue, semantic layer and quality checks."""
