"""Column functions: URLs, titles, times, labels and checks."""
