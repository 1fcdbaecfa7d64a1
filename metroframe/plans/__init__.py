"""Distributed building blocks shared by the operators."""
