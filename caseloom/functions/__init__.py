"""Column functions: strings, spans, scores, dates and JSON."""
