"""Column expressions shared by the operators and checks."""
