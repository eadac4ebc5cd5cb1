"""Column functions: text normalisation, tokens, sentences, vectors."""
