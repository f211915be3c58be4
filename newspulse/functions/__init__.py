"""Column expressions: text cleaning, tokens, links, labels, dates."""
