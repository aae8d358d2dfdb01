"""Readers of mail folders and JSON lines."""

from quillrock.operators.mail import questions, read_jsonl, read_maildir

__all__ = ["questions", "read_jsonl", "read_maildir"]
