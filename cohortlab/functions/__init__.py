"""Scalar expressions: id cleaning, hashing, distribution tails."""
