"""An extension: the same import over documents that arrive in a folder."""
