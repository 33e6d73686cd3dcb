"""Sources and sinks: raw landing, load guards, driver tables."""
