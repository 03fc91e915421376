"""Image and mask files."""
