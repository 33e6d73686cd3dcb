"""Race feeds derived from the driver tables: test data, not part of the library."""
