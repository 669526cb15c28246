"""Sources and sinks: sequence files, path lists, tables of hits and distances, and a run's outputs."""
