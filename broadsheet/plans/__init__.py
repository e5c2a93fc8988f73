"""Reports and composite jobs built from the operators."""
