"""Reading, checking and writing series tables."""
