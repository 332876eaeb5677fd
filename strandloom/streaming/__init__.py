"""No stream operators: graphs are batch tables, and large inputs are read in splits."""
