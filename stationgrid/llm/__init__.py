"""Training-data operators over text and vectors; one query per operator in ``queries``."""
