"""Inputs: the city dimension, the collection spine, landed calls and provider payload readers."""
