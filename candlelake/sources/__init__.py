"""Reading exchange messages, topics and lakehouse tables."""
