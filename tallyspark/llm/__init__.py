"""Training-data operators: one module per operator, general DataFrame interfaces."""
