"""Column expressions: texts, spellings, tokens. All are built-in functions, so Catalyst sees through them."""
