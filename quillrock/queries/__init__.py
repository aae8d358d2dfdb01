"""Core queries by topic, each with its SQL twin where SQL can express it."""
