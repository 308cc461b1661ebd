"""Column functions: text, sections, citations, quantities."""
