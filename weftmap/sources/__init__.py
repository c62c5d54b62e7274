"""Finding and reading source files, the parse cache, and the cluster's shared folder."""
