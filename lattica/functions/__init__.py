"""Column functions: text normalisation, tokens, similarity, keys and formats."""
