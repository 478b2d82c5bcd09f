"""Training-data operators: tokens, packing, filtering and near-duplicate removal.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library.
"""
