"""functions of loomspan."""
