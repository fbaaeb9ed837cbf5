"""The query catalogue, one function an operator."""
