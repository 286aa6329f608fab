"""Readers for every input the engine takes."""
