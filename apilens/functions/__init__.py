"""Column builders: the scanner's regular rules as Catalyst expressions."""
