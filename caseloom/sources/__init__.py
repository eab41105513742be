"""Sources and sinks: pattern files, stores of chunks and entities, exports."""
