"""Reading and writing the stores, and turning raw input into rows."""
