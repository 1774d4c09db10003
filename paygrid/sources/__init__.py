"""Sources and sinks: driver tables, postings/history files, board payloads, pages."""
