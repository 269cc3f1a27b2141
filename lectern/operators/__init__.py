"""Operators over DataFrames: decoding, pairing, metrics, geometry and answers."""
