"""Column functions: text cleaning, counting, urls, formatting."""
