"""Cypher front end: text -> tree -> DataFrame plans."""
