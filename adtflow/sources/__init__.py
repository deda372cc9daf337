"""Sources and sinks: framed messages as a Spark data source, schema trees, generated files."""
