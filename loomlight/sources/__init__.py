"""Reading and writing of the domain tables."""
