"""What is asked of the data."""
