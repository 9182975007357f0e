"""Sources and sinks: table scans, the product-week panel, CSV and spec I/O."""
