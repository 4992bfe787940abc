"""Message tables from the given data, files and sinks."""
