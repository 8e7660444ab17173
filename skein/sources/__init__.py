"""Relations read from tables, files and logs, and the sinks that keep them."""
