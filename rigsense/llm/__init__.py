"""Operators for preparing training text: each is one module, ``queries`` registers them."""
