"""Column functions: identity keys, hashing, binary fields."""
