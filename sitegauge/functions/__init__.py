"""Column functions: text, URLs, numbers, selectors and model replies."""
