"""Column functions, fixed word lists and display formats."""
