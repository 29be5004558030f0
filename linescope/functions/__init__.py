"""Column expressions: patterns, spans, tokens, widths and colours."""
