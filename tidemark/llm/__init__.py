"""Operators for training data of language models, with their queries; nothing else imports this package."""

from tidemark.llm.queries import registry

__all__ = ["registry"]
