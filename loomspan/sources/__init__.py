"""sources of loomspan."""
