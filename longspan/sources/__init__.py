"""Sources, sinks and validation scans."""
