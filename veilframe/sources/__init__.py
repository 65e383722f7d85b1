"""sources of the text-privacy engine."""
