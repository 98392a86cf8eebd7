"""Training-data operators on document tables; nothing else in the package imports them."""
