"""Column builders: coercion, name decomposition, vocabularies, state hashing."""
