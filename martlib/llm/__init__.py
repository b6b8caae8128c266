"""Operators for preparing large text corpora. Nothing else in martlib imports this subpackage."""
