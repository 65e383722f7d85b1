"""functions of the text-privacy engine."""
