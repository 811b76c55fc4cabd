"""Column expressions and codecs shared by the operators."""
