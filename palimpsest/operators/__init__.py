"""DataFrame operators on the tables of a repository."""
