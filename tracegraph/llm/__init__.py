"""Operators for building training corpora: scoring, cleaning, de-duplication, mixing, sharding, archives."""
