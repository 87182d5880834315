"""Sources and sinks: CSV / text / ZIP scans, layout detection, CSV export."""
