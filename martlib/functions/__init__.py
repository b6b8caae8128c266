"""Functions that return a Column; built-in expressions alone, so they stay in generated code."""
