"""Column functions: text normalisation, answers, protocol markers."""
