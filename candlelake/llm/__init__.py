"""Operators that prepare training text: repeats, near copies, mixing, secrets, chat, toxicity, quality, archives, leaks, HTML."""
