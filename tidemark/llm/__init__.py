"""Training-data operators: each module holds one operator with a general interface.

Nothing outside this subpackage imports it; ``tidemark.llm.queries`` derives the
contract columns of the registered queries from the operators' real outputs.
"""
