"""Operators that prepare text corpora for training. Nothing outside this subpackage imports it."""
