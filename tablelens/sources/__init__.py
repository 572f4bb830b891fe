"""Reading the tables to be looked into."""
