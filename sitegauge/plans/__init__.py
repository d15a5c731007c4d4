"""Plan building blocks shared by operators, and the catalogue of queries."""
