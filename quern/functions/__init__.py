"""Column functions over text, ranks and vectors."""
