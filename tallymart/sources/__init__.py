"""Readers, writers and the star schema the operators work on."""
