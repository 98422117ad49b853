"""operators of loomspan."""
