"""Operators on free text and vectors for training data; nothing else imports this."""
