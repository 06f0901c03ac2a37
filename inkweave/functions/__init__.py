"""Column expressions: text, identifiers, concepts, letter scales and vectors. None of them shuffles or runs Python."""
