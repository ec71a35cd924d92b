"""Column helpers and the block-wise window toolkit used by all operators."""
