"""Decision rules as column expressions."""
