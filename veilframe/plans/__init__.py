"""plans of the text-privacy engine."""
