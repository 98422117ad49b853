"""jobs of loomspan."""
