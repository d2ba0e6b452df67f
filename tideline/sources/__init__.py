"""Table readers, epoch tagging, sinks and the shared-folder helpers."""
