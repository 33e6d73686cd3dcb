"""pitwall: Spark-native timing and telemetry analytics.

Semi-structured records land as VARIANT, staging turns them into typed,
latest-per-key tables, marts build a star schema, and a catalogue of
parameterised queries, a semantic layer and declarative quality checks sit
on top. Everything is DataFrame / Spark SQL composition.
"""

__version__ = "0.1.0"
