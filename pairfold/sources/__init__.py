"""Sources and sinks: image folders, snapshots, the result log."""
