"""Articles arriving in daily files."""
