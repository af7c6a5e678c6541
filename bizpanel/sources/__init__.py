"""Table schemas, loaders, JSON requests, profiling and sinks."""
