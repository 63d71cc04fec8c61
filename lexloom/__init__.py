"""lexloom: word lists, fuzzy matching, ordered sequences and reading scores as Spark DataFrame operators."""
