"""Training-data operators: ten independent DataFrame operators and their registered queries.

Nothing outside this subpackage imports it; the folder can be removed as a whole.
"""
