"""operators of the text-privacy engine."""
