"""Models, reports and checks composed from the operators."""
