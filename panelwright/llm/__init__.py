"""Operators for large-scale training-data preparation.

What holds for all of them, unless a docstring says otherwise: a null text counts as an empty
one; texts of any length are read whole, in one row of an Arrow batch; a repeated row is a row
of its own and returns as often as it came; ties are settled by the smallest id or name; other
columns pass through, and those whose names an output takes give way to it; an empty table
gives an empty result.
"""
