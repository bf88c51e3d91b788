"""Operators for preparing training text. Nothing else in quillspark imports this subpackage."""
