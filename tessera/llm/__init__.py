"""Training-data operators: ten scalable text operators and the pipeline built from them.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
