"""Operators over documents, clauses, chunks, versions, questions and answers."""
