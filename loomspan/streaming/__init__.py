"""streaming of loomspan."""
