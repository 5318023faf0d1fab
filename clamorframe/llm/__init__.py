"""Training-data pipeline operators over ``documents``; nothing outside this package imports them."""
