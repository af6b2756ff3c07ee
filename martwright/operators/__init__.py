"""DataFrame operators shared by the models and the reports."""
