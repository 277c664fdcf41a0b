"""Training-data operators: each module holds one operator, its query and, where SQL can express it, its oracle.

Nothing outside this subpackage imports it.
"""
