"""Text-corpus operators: formatting, filtering, joining, mixing and encoding."""
