"""Where documents and tables come from."""
