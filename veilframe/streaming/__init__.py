"""streaming of the text-privacy engine."""
