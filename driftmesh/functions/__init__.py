"""Column functions: built-in expressions only, so they stay within whole-stage code generation."""
